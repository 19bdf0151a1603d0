"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import signal
from framewright.plans import catalogue
from framewright.sources import container


def _norm(v):
    return round(v, 9) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def compare(spark, data, df, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(_norm(r[i]) for i in order) for r in cur.fetchall()), key=str)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, data, name):
    compare(spark, data, catalogue.QUERIES[name](spark, data), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", ["norm_bucket_codebook", "polar_quantize", "polar_payload_roundtrip"])
def test_norms_between_printed_and_exact_levels(spark, tmp_path, name):
    """Norms beside each decision level: of the channels behind the anchors, and of all channels times the queries' factor."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(8)
    rows = []
    for level in (0.2582, 0.5224, 0.7996, 1.099, 1.437, 1.844, 2.401):
        for off in (-6e-5, -2e-5, -2e-6, 2e-6, 2e-5, 6e-5, 3e-4):
            for first in (0, 24):
                x = rng.standard_normal(64)
                norm = (level + off) / (1 if first else (len(rows) % 5 + 1) * 0.45)
                rows.append((x * (norm / np.linalg.norm(x[first:]))).astype(np.float32))
    found = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array([v.tolist() for v in rows], pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})
    pq.write_table(found, f"{tmp_path}/embeddings.parquet")
    compare(spark, str(tmp_path), catalogue.QUERIES[name](spark, str(tmp_path)), catalogue.SQL[name])


def test_silence_of_any_length(spark, tmp_path):
    """Lengths whose zeros would not fit one array, and unknown ones."""
    con = duckdb.connect()
    con.execute(f"copy (select * from (values (5::bigint, 400000), (11, 50), (6, 0), (7, null), (3, 400001)) t(p_partkey, p_size)) to '{tmp_path}/part.parquet'")
    compare(spark, str(tmp_path), catalogue.QUERIES["rates_and_silence"](spark, str(tmp_path)), catalogue.SQL["rates_and_silence"])


def test_containers_follow_the_input(spark, tmp_path):
    """More documents of one file than a container's count can hold."""
    n = 70_000
    docs = spark.range(n).selectExpr("id * 16 AS doc_id", "concat('t', id) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue._entries(spark, str(tmp_path)).selectExpr("max(n_entries)").first()[0] <= catalogue.VOLUME
    back = catalogue.QUERIES["container_roundtrip"](spark, str(tmp_path))
    row = back.selectExpr("count(*)", "count(DISTINCT entry_idx)", "max(entry_idx)").first()
    wrong = back.filter("file <> 'part-0' OR name <> concat('doc/', entry_idx * 16, '.bin') OR payload_len <> length(entry_idx) + 1").count()
    assert (*row, wrong) == (n, n, n - 1, 0)
    meta = catalogue.QUERIES["container_meta_scan"](spark, str(tmp_path)).collect()
    assert [(r.file, r.modality, r.n) for r in meta] == [("part-0", container.IMAGE, n)]


def test_speaker_embedding(spark):
    """Against a numpy version with a loop for each frame and filter."""
    rng = np.random.default_rng(6)
    signals = {u: rng.standard_normal(n) + 0.5 for u, n in ((1, 64), (2, 99), (3, 300))}
    rows = [(u, i, float(v)) for u, x in signals.items() for i, v in enumerate(x)] + [(4, i, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    got = {r.k: r.embedding for r in signal.embedding(signal.spectrum(df, "k", "i", "v", 16000, 64, 32), "k", 16000, 64).collect()}
    assert set(got) == set(signals)  # a signal shorter than a frame has none
    t = np.arange(64)
    window = np.array([0.5 * (1 - math.cos(2 * math.pi * x / 16)) if x < 8 else 1.0 if x <= 56 else 0.5 * (1 - math.cos(2 * math.pi * (64 - x) / 16)) for x in t])
    corners = [int(700 * (10 ** (m / 2595) - 1) / 8000 * 32) for m in np.linspace(2595 * math.log10(1 + 80 / 700), 2595 * math.log10(1 + 7600 / 700), 22)]
    for u, x in signals.items():
        power = []
        for s in range(0, len(x) - 63, 32):
            y = (x[s : s + 64] - x[s : s + 64].mean()) * window
            p = np.array([abs((y * np.exp(-2j * math.pi * k * t / 64)).sum()) ** 2 for k in range(33)]) / window.sum() ** 2
            p[1:32] *= 2
            power.append(p)
        power = np.mean(power, axis=0)
        energy = []
        for lo, mid, hi in zip(corners, corners[1:], corners[2:]):
            energy.append(sum(power[k] * (k - lo) / (mid - lo) for k in range(lo, mid)) + sum(power[k] * (hi - k) / (hi - mid) for k in range(mid, hi)))
        logs = np.log(np.maximum(energy, 1e-10))
        c = np.array([math.sqrt((1 if k == 0 else 2) / 20) * sum(e * math.cos(math.pi * k * (2 * m + 1) / 40) for m, e in enumerate(logs)) for k in range(20)])
        assert np.allclose(got[u], c / np.linalg.norm(c), atol=1e-9)


def test_compression_ratio_counts_every_row_once(spark, tmp_path):
    import zstandard

    texts = [" ".join(f"w{i * i % (k + 7)}" for i in range(400)) for k in range(4)]
    docs = spark.createDataFrame([(i, "s", t) for i, t in zip((1, 1, 2, None), texts)] + [(5, None, None)], "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: (r.bytes, r.packed) for r in catalogue.QUERIES["compression_ratio_report"](spark, str(tmp_path)).collect()}
    packed = sum(len(zstandard.ZstdCompressor(level=19).compress(t.encode())) for t in texts)
    assert got == {"s": (sum(map(len, texts)), packed), None: (None, None)}


def test_codec_is_close(spark, data):
    assert catalogue.QUERIES["codec_roundtrip"](spark, data).filter("psnr < 50").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 30
    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_reports_of_the_command_line(spark, tmp_path, capsys):
    from framewright import __main__ as m

    (tmp_path / "in").mkdir()
    for n in ("a.png", "b.wav"):
        (tmp_path / "in" / n).write_bytes(n.encode() * 900)
    m.pack(spark, str(tmp_path / "in"), str(tmp_path / "c.mpack"), 95.0, 3.0)
    out = capsys.readouterr().out
    assert "lossless" in out and "3,600 bytes" not in out and "% of target)" in out and out.count("EXACT MATCH") == 2
    m.unpack(spark, str(tmp_path / "c.mpack"), str(tmp_path / "in"))
    assert (tmp_path / "c_unpacked" / "0_a.png").read_bytes() == b"a.png" * 900
