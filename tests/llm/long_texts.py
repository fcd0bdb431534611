"""Peaks of a registered query over a table with one text of many MB: python long_texts.py QUERY MB FOLDER.

Prints MB of the largest Python worker. The JVM, which is the executor and the driver of a local master, has a heap of 2 GB.
Workers are not used again, so that none holds what an earlier one left; one core, so that one task runs at a time.
"""

from __future__ import annotations

import os
import random
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def text_of(kind: str, mb: int) -> str:
    """prose: words of a vocabulary of 200,000; terms: 200 words that are all test items; hits: one test passage again and again."""
    rng = random.Random(1)
    if kind == "hits":
        return (" ".join(f"p{i}" for i in range(13)) + " ") * (mb * 1_000_000 // 44)
    many = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 10))) for _ in range(200_000 if kind == "prose" else 200)]
    return " ".join(rng.choices(many, k=mb * 150_000))[: mb * 1_000_000]


def tables(kind: str, mb: int, folder: str) -> None:
    import pandas as pd

    rng = random.Random(2)
    long_text = text_of(kind, mb)
    short = [" ".join(rng.choices(long_text[:20_000].split(), k=120)) for _ in range(60)] + ["a b", "", None]
    docs = pd.DataFrame({"doc_id": range(len(short) + 1), "text": [long_text, *short], "lang": ["en", "fr"] * (len(short) // 2) + ["en"] * (1 + len(short) % 2), "source": "s", "n_chars": 1})
    docs.to_parquet(f"{folder}/documents.parquet")
    items = sorted(set(long_text[:20_000].split()))[:200] + [" ".join(f"p{i}" for i in range(13))]
    pd.DataFrame({"item_id": range(len(items)), "text": items}).to_parquet(f"{folder}/benchmark.parquet")
    pd.DataFrame({"doc_id": range(60), "quality": [0, 1] * 30, "toxic": 0}).to_parquet(f"{folder}/labels.parquet")


def workers(peaks: dict[str, int], stop: threading.Event) -> None:
    import psutil

    while not stop.is_set():
        for p in psutil.Process().children(recursive=True):
            try:
                # By the command: a process that the JVM is just starting still has its memory, and another name.
                name = "worker" if "pyspark.daemon" in " ".join(p.cmdline()) else "jvm"
                peaks[name] = max(peaks.get(name, 0), p.memory_info().rss >> 20)
            except psutil.Error:
                pass
        time.sleep(0.05)


def main(query: str, mb: str, folder: str, kind: str = "prose") -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__

    tables(kind, int(mb), folder)
    spark = (
        SparkSession.builder.master("local[1]").config("spark.driver.memory", "2g").config("spark.python.worker.reuse", "false").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    peaks, stop = {}, threading.Event()
    watch = threading.Thread(target=workers, args=(peaks, stop))
    watch.start()
    began = time.time()
    try:
        __spark_entry__.queries()[query](spark, folder).write.parquet(f"{folder}/out")
        print("RESULT", query, kind, mb, "rows", spark.read.parquet(f"{folder}/out").count(), "worker", peaks.get("worker", 0), "jvm", peaks.get("jvm", 0), "seconds", round(time.time() - began))
    finally:
        stop.set()
        watch.join()
        spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
