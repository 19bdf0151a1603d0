"""Command line: pack a folder into a container, list or unpack one, list a model catalogue.

Payloads are the files' own bytes: neural codecs plug in through sources.codecs, outside this repository.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import functions as F

from .functions import scalars as s
from .plans import planner as pl
from .session import local_session
from .sources import container, files


def pack(spark, folder: str, out: str, target_size: float | None, audio_bandwidth: float, quality: int | None = None) -> None:
    rows = files.scan(spark, folder, content=True)
    if rows.isEmpty():
        raise SystemExit(f"no media files in {folder}")
    kind = {"image": container.IMAGE, "audio": container.AUDIO, "video": container.VIDEO}
    floor = pl.bandwidth(rows, "path", audio_bandwidth).first()
    p = pl.tier_params(F.lit(float(target_size if target_size is not None else 0.0)))
    numbered = rows.withColumn("entry_idx", F.rank().over(pl.W.orderBy("name")) - 1)  # a listing, one row for each file
    entries = numbered.select(
        F.lit(os.path.basename(out)).alias("file"), "entry_idx", F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])[F.col("modality")].alias("modality"),
        "name", (p["quality"] if target_size is not None or quality is None else F.lit(quality)).alias("quality"), F.lit(float(floor.bandwidth)).cast("float").alias("bandwidth"), F.col("content").alias("payload"),
    )
    container.write(container.pack(entries), os.path.dirname(os.path.abspath(out)))
    before = rows.agg(F.sum("length")).first()[0]
    after = os.path.getsize(out)
    lines = [pl.describe(p), pl.saved_line(F.lit(before), F.lit(after))]
    if target_size is not None:
        lines.append(pl.target_line(pl.target_bytes(F.lit(before), F.lit(float(target_size))), F.lit(after)))
    for line in spark.range(1).select(*lines).first():
        print(f"{out}: {line}")
    if spark.range(1).select(p["lossless"]).first()[0]:
        back = container.read(spark, out).select("name", F.col("payload").alias("recovered")).join(rows.select("name", "content"), "name")
        for r in pl.fidelity_report(back, "content", "recovered", F.lit(True)).orderBy("name").collect():
            print(f"{r.name}: {r.outcome} (original {r.hash_a}, recovered {r.hash_b})")


def unpack(spark, path: str, originals: str | None) -> None:
    meta = container.read(spark, path, metadata_only=True).select("entry_idx", s.basename(F.col("name")).alias("name"), "modality", "payload_len")
    if originals:
        meta = pl.match_originals(meta, files.scan(spark, originals).select("path"))
    meta.orderBy("entry_idx").show(1000, False)
    to = os.path.splitext(path)[0] + "_unpacked"
    whole = container.read(spark, path).select(F.concat(F.col("entry_idx").cast("string"), F.lit("_"), s.basename(F.col("name"))).alias("file"), F.col("payload").alias("content"))
    container.write(whole, to)
    print(f"written to {to}")


def main() -> None:
    parser = argparse.ArgumentParser(prog="framewright")
    sub = parser.add_subparsers(dest="what", required=True)
    a = sub.add_parser("pack")
    a.add_argument("folder")
    a.add_argument("--out")
    a.add_argument("--target-size", type=float)
    a.add_argument("--audio-bandwidth", type=float, default=3.0)
    a.add_argument("--quality", type=int, choices=range(1, 7))
    b = sub.add_parser("unpack")
    b.add_argument("file")
    b.add_argument("--originals")
    m = sub.add_parser("models")
    m.add_argument("catalogue")
    args = parser.parse_args()
    spark = local_session(4, "2g", **{"spark.ui.showConsoleProgress": "false"})
    if args.what == "pack":
        folder = args.folder.rstrip("/")
        pack(spark, folder, args.out or os.path.splitext(folder)[0] + ".mpack", args.target_size, args.audio_bandwidth, args.quality)
    elif args.what == "unpack":
        unpack(spark, args.file, args.originals)
    else:
        pl.catalogue(spark, args.catalogue).show(1000, False)


if __name__ == "__main__":
    main()
