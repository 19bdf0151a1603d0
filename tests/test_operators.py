import math
import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.functions import scalars as s
from framewright.operators import latents as la
from framewright.operators import sequence as sq
from framewright.operators import signal as sg
from framewright.plans import planner as pl
from framewright.sources import container, files


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


@pytest.mark.parametrize("pct,quality,lossless", [(0.5, 1, False), (0.99, 1, False), (1, 2, False), (2.99, 2, False), (3, 3, False), (7.99, 3, False), (8, 5, False), (14.99, 5, False), (15, 5, False), (89.99, 5, False), (90, 5, True), (100, 5, True)])
def test_tiers(spark, pct, quality, lossless):
    p = one(spark, p=pl.tier_params(F.lit(float(pct))))["p"]
    assert (p.quality, p.lossless) == (quality, lossless)
    r = pl.rules(spark).filter((F.col("lo_pct") <= pct) & (F.lit(float(pct)) < F.col("hi_pct"))).collect()
    assert len(r) == 1 and r[0].quality == quality


def test_verdicts(spark):
    rows = spark.createDataFrame([(v,) for v in (19.99, 20.0, 25.0, 30.0, 30.01, math.inf, math.nan, None)], "p double")
    got = [r[0] for r in rows.select(la.verdict(F.col("p"))).collect()]
    assert got == ["TurboQuantizing is too aggressive.", "Acceptable.", "Acceptable.", "Acceptable.", "Great.", "Great.", None, None]


def test_half_even(spark):
    v = spark.createDataFrame([(x,) for x in (-2.5, -1.5, -0.5, 0.5, 1.5, 2.5)], "v double")
    assert [r[0] for r in v.select(s.half_even(F.col("v"))).collect()] == [-2, -2, 0, 0, 2, 2]


def test_names(spark):
    p = spark.createDataFrame([("a/Chateau.WAV",), (".wav",), ("x.y/noext",), ("rocket.mp4",)], "p string")
    got = [tuple(r) for r in p.select(s.extension(F.col("p")), s.modality(F.col("p")), s.is_speech(F.col("p")), s.is_music(F.col("p"))).collect()]
    assert got == [(".wav", "audio", True, False), ("", None, False, False), ("", None, False, False), (".mp4", "video", False, True)]


def test_bits_and_bytes(spark):
    bits = [1, 0, 1, 1, 0, 0, 0, 1, 1]
    packed = one(spark, b=la.pack_bits(F.array(*[F.lit(b) for b in bits])))["b"]
    assert bytes(packed) == bytes([0b10110001, 0b10000000])
    assert one(spark, u=la.unpack_bits(F.lit(bytes(packed)), 9))["u"] == bits
    assert one(spark, h=s.le_hex(F.lit(0x01020304), 4))["h"] == "04030201"
    assert one(spark, h=s.from_le_hex(F.lit("04030201")))["h"] == 0x01020304


def test_silence_has_its_samples(spark):
    df = spark.createDataFrame([(0.25, 8), (0.3, 11025), (0.0, 8000), (-1.0, 8000), (None, 8000)], "s double, r int")
    got = df.select(s.samples(F.col("s"), F.col("r")).alias("n"), s.silence(F.col("s"), F.col("r")).alias("z")).collect()
    assert [r.n for r in got] == [2, 3307, 0, 0, None]
    assert [r.z for r in got] == [None if r.n is None else [0.0] * r.n for r in got]


def test_codebook():
    thresholds, centres = la.codebook(8)
    assert len(thresholds) == 7 and len(centres) == 8
    assert all(a < t < b for a, t, b in zip(centres, thresholds, centres[1:]))


def test_codebook_is_the_published_one():
    """Max (1960): output levels of the 16-level quantiser of a normal variable, the positive half."""
    assert np.allclose(la.codebook(8)[1], [0.1284, 0.3881, 0.6568, 0.9424, 1.256, 1.618, 2.069, 2.733], atol=6e-4)
    assert np.allclose(la.codebook(4)[1], [0.2451, 0.7560, 1.344, 2.152], atol=6e-4)


def test_rotation_is_the_seeded_matrix_s():
    q, a = la.rotation(16, 42), np.random.RandomState(42).standard_normal((16, 16))
    assert np.abs(np.tril(q.T @ a, -1)).max() < 1e-9


def test_recursion_by_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 1000):
        for b, a in (((1.0, 0.0, 0.0), (1.0, -0.97, 0.0)), ((0.3, 0.2, 0.1), (2.0, 0.4, -0.3))):
            x, y = rng.standard_normal(n), []
            past = lambda v, t: v[t] if t >= 0 else 0.0
            for t in range(n):
                y.append((b[0] * x[t] + b[1] * past(x, t - 1) + b[2] * past(x, t - 2) - a[1] * past(y, t - 1) - a[2] * past(y, t - 2)) / a[0])
            assert np.allclose(sq.recursion(x, b, a), y)


def test_arrays_times_matrices(spark):
    m = np.arange(6.0).reshape(3, 2)
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, None)], "k int, v array<double>")
    assert [r[0] for r in df.orderBy("k").select(la.times(F.col("v"), m)).collect()] == [[16.0, 22.0], None]
    assert df.limit(0).select(la.times(F.col("v"), m)).count() == 0


def test_noise_floor_is_the_exact_percentile(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.exponential(1, 1001), "b": np.repeat([0.0, 1.0, 5.0], [30, 200, 3]), "c": np.array([7.0]), "d": np.zeros(4), "e": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None)]
    for part in (0.0, 0.1, 0.5, 1.0):
        got = {r.k: r.noise for r in sg.noise_floor(spark.createDataFrame(rows, "k string, m double"), ["k"], "m", part).collect()}
        assert got == pytest.approx({k: float(np.quantile(x, part)) for k, x in groups.items()})


def test_high_layer(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(700)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, 0, 1.0)], "k int, i int, v double")
    layers = sg.high_layer(df, "k", "i", "v", 24000, 9)
    got = {r.k: r for r in layers.collect()}
    assert (got[1].chunks, len(got[1].bits), got[2].chunks, len(got[2].bits)) == (5, 5 * 32 // 8, 0, 0)
    high = sg._high_passed(x, 24000, 8000.0)[:640].reshape(128, 5)
    turn, sign = la.rotation(128, 9 ^ 0xCAFEBABE), la.signs(128, 32, 9 ^ 0xCAFEBABE)
    bits = [int((turn @ high[:, c]) @ sign[:, j] >= 0) for c in range(5) for j in range(32)]
    assert np.unpackbits(np.frombuffer(got[1].bits, np.uint8)).tolist() == bits
    back = {r.idx: r.correction for r in sg.from_high_layer(layers, "k", 9).filter("k = 1").collect()}
    want = np.stack([turn.T @ (sign @ (np.array(bits[32 * c : 32 * c + 32]) * 2.0 - 1) * 0.02 / 32) for c in range(5)], 1).reshape(-1)
    assert np.allclose([back[i] for i in range(640)], want)
    corrected = la.add_to_prefix(df.select("k", F.col("i").alias("idx"), F.col("v").alias("value")), sg.from_high_layer(layers, "k", 9).select("k", "idx", F.col("correction").alias("value")), ["k", "idx"])
    assert corrected.count() == 701


def test_rotation_keeps_lengths():
    q = la.rotation(32, 5)
    assert np.abs(q @ q.T - np.eye(32)).max() < 1e-9


def test_quantisation_error_is_bounded(spark):
    x = spark.createDataFrame([(i, c, math.sin(i * 7 + c)) for i in range(20) for c in range(4)], "item int, pos int, value double")
    last = 0.0
    for bits in range(2, 9):
        q = la.dequantise(la.quantise(x, la.channel_scales(x, bits), bits))
        assert q.filter(F.abs(F.col("value") - F.col("restored")) > F.col("scale") / 2 + 1e-9).count() == 0
        p = la.quality(q.withColumn("g", F.lit(1)), ["g"]).first().psnr
        assert p > last
        last = p


def test_upsample_is_half_pixel_bilinear(spark):
    small = spark.createDataFrame([(1, 0, 0, 0.0), (1, 0, 1, 1.0), (1, 1, 0, 2.0), (1, 1, 1, 3.0)], "k int, y int, x int, value double")
    got = {(r.y, r.x): r.value for r in la.upsample(small, 2, 4, 4, ["k"]).collect()}
    axis = [0.0, 0.25, 0.75, 1.0]
    assert got == pytest.approx({(y, x): 2 * axis[y] + axis[x] for y in range(4) for x in range(4)})


def test_gaps(spark):
    rows = [("a", 0, None), ("a", 1, 1.0), ("a", 2, None), ("a", 3, None), ("a", 4, 4.0), ("a", 5, None), ("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {(r.k, r.i): r.filled for r in sq.interpolate(df, ["k"], "i", "v").collect()}
    assert [got["a", i] for i in range(6)] == [1, 1, 2, 3, 4, 4] and got["b", 0] is None
    assert [r.filled for r in sq.forward_fill(df, ["k"], "i", "v").orderBy("k", "i").collect()] == [0, 1, 1, 1, 4, 4, 0]


def test_emphasis_round_trip(spark):
    df = spark.createDataFrame([("a", i, math.sin(i)) for i in range(50)], "k string, i int, v double")
    back = sq.de_emphasis(sq.pre_emphasis(df, ["k"], "i", "v"), "k", "i", "emphasised").join(df, ["k", "i"])
    assert back.filter(F.abs(F.col("restored") - F.col("v")) > 1e-9).count() == 0


def test_post_filter_keeps_level(spark):
    df = spark.createDataFrame([("a", i, 0.1 * math.sin(i / 3)) for i in range(2000)], "k string, i int, v double")
    out = sg.post_filter(df, "k", "i", "v", 24000)
    assert out.count() == 2000
    a, b = df.agg(sg.rms(F.col("v"))).first()[0], out.agg(sg.rms(F.col("filtered"))).first()[0]
    assert abs(a - b) < 0.02


def test_high_pass_removes_low_tones(spark):
    df = spark.createDataFrame([(int(f), i, math.sin(2 * math.pi * f * i / 48000)) for f in (200, 16000) for i in range(2000)], "k int, i int, v double")
    level = {r.k: r.l for r in sg.high_pass(df, "k", "i", "v", 48000).filter("i > 500").groupBy("k").agg(sg.rms(F.col("high")).alias("l")).collect()}
    assert level[200] < 0.01 and level[16000] > 0.5


entry = st.fixed_dictionaries({"modality": st.integers(0, 4), "name": st.text(max_size=20), "payload": st.binary(max_size=40), "aux_payload": st.binary(max_size=10), "width": st.integers(0, 65535), "height": st.integers(0, 65535), "sample_rate": st.integers(0, 2**32 - 1), "num_samples": st.integers(0, 2**32 - 1), "channels": st.integers(0, 255), "quality": st.integers(0, 255), "codec_id": st.integers(0, 255), "total_frames": st.integers(0, 2**32 - 1)})


@settings(max_examples=60, deadline=None)
@given(st.lists(entry, max_size=5))
def test_container_round_trip(rows):
    data = struct.pack("<4sBH", container.MAGIC, 8, len(rows)) + b"".join(map(container.pack_entry, rows))
    back = list(container.entries(data))
    assert [(r["modality"], r["name"], r["payload"]) for r in back] == [(r["modality"], r["name"], r["payload"]) for r in rows]
    assert [r["payload_len"] for r in container.entries(data, keep=False)] == [len(r["payload"]) for r in rows]
    assert all(data[r["payload_offset"] : r["payload_offset"] + r["payload_len"]] == r["payload"] for r in back)


def test_container_errors_and_old_versions():
    for bad in (b"NOPE\x08\x00\x00", struct.pack("<4sBH", container.MAGIC, 0, 0), struct.pack("<4sBH", container.MAGIC, 9, 0), struct.pack("<4sBH", container.MAGIC, 8, 1) + b"\x00"):
        with pytest.raises(ValueError):
            list(container.entries(bad))
    assert list(container.entries(struct.pack("<4sBH", container.MAGIC, 8, 0))) == []
    body = struct.pack("<H", 1) + b"n" + struct.pack("<HH4If", 5, 6, 1, 128, 2, 2, 0.5)
    for version in range(1, 8):
        data = struct.pack("<4sBH", container.MAGIC, version, 1) + (b"\x00" if version >= 3 else b"") + body
        data += (b"\x02" if version >= 7 else b"") + struct.pack("<I", 3) + b"abc" + (struct.pack("<I", 0) if version >= 2 else b"")
        (e,) = container.entries(data)  # the turbo byte may be missing
        assert (e["width"], e["height"], e["payload"], e["scale"]) == (5, 6, b"abc", 0.5)


def test_container_files(spark, tmp_path):
    rows = spark.createDataFrame([("c.bin", i, i % 5, f"../n{i}é.png", b"x" * i) for i in range(7)], "file string, entry_idx int, modality int, name string, payload binary")
    container.write(container.pack(rows), str(tmp_path))
    full = container.read(spark, str(tmp_path)).orderBy("entry_idx").collect()
    assert [(r.name, bytes(r.payload)) for r in full] == [(f"../n{i}é.png", b"x" * i) for i in range(7)]
    meta = container.read(spark, str(tmp_path), metadata_only=True)
    assert "payload" not in meta.columns and [(r.entry_idx, r.modality, r.name, r.payload_offset) for r in meta.orderBy("entry_idx").collect()] == [(r.entry_idx, r.modality, r.name, r.payload_offset) for r in full]
    assert meta.agg(F.sum("payload_len")).first()[0] == 21
    assert meta.select(s.output_name(F.col("name"), F.lit("audio")).alias("n")).filter(F.contains("n", F.lit("/"))).count() == 0


def test_packing_leaves_payloads_in_the_jvm(spark):
    """The same bytes as entry by entry, of all modalities and with missing values; only heads are made in Python."""
    kinds = "file string, entry_idx int, modality int, name string, width bigint, fps float, sample_rate bigint, bandwidth float, payload binary, aux_payload binary"
    names = [x.split()[0] for x in kinds.split(", ")]
    rows = [(f"c{i % 3}", 40 - i, i % 6, f"né{i}" if i % 4 else None, i if i % 5 else None, 0.1 * i, 8000, None if i % 2 else 3.3, bytes(range(i)) if i % 7 else None, b"\xff\x00" * i if i % 9 else None) for i in range(40)]
    packed = container.pack(spark.createDataFrame(rows, kinds).repartition(3))
    got = {r.file: (bytes(r.content), r.n_entries) for r in packed.collect()}
    single = lambda x: None if x is None else struct.unpack("<f", struct.pack("<f", x))[0]
    for file in ("c0", "c1", "c2"):
        own = [dict(zip(names, r)) for r in sorted(rows, key=lambda r: r[1]) if r[0] == file]
        body = b"".join(container.pack_entry({**r, "fps": single(r["fps"]), "bandwidth": single(r["bandwidth"])}) for r in own)
        assert got[file] == (struct.pack("<4sBH", container.MAGIC, 8, len(own)) + body, len(own))
    plan = packed._jdf.queryExecution().executedPlan().toString()
    python = [x for x in plan.splitlines() if "Python [" in x or "InArrow" in x]
    lengths = r"octet_length\(coalesce\(\w*payload#\d+, 0x\)\)"
    assert python and not any("InArrow" in x or "payload" in re.sub(lengths, "", x[: x.index("]")]) for x in python)
    with pytest.raises(Exception, match="too many entries"):
        container.pack(spark.range(65_536).selectExpr("'c' file", "id entry_idx", "0 modality", "'n' name")).collect()


def test_metadata_of_all_versions(spark):
    """The expression that steps from head to head, against the reader of whole entries."""
    blob = lambda b: struct.pack("<I", len(b)) + b
    files = []
    for version in range(1, 9):
        body = b""
        for k in range(3):
            if version >= 3:
                body += bytes([container.IMAGE])
            name = f"né{k}.png".encode()
            body += struct.pack("<H", len(name)) + name
            if version == 8:
                body += struct.pack("<HHBB", 3, 4, 0, 2)
            else:
                body += struct.pack("<HH4If", 5, 6, 1, 128, 2, 2, 0.5) + (b"\x02" if version >= 7 else b"")
            body += blob(b"p" * (k * 70000)) + (blob(b"q" * k) if version >= 2 else b"")
            if 5 <= version < 8:
                body += b"\x01" + struct.pack("<I", 7) + blob(b"a") + blob(b"") + blob(b"ccc") if k == 1 else b"\x00" if k == 0 else b""
        files.append((f"v{version}", struct.pack("<4sBH", container.MAGIC, version, 3) + body))
    mixed = [{"modality": m, "name": f"m{m}", "payload": b"x" * (10 + m), "aux_payload": b"y" * m} for m in range(5)]
    files += [("mixed", struct.pack("<4sBH", container.MAGIC, 8, 5) + b"".join(map(container.pack_entry, mixed))), ("none", struct.pack("<4sBH", container.MAGIC, 8, 0))]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {(r.file, r.entry_idx): (r.version, r.modality, r.name, r.payload_len, r.aux_payload_len, r.payload_offset) for r in container.metadata(df).collect()}
    want = {(f, e["entry_idx"]): (e["version"], e["modality"], e["name"], e["payload_len"], e.get("aux_payload_len"), e["payload_offset"]) for f, data in files for e in container.entries(data, False)}
    assert got == want
    for bad in (b"NOPE\x08\x00\x00", struct.pack("<4sBH", container.MAGIC, 9, 0), files[8][1][:-1]):
        with pytest.raises(Exception):
            container.metadata(spark.createDataFrame([("f", bad)], "path string, content binary")).collect()


def test_payload_scales(spark):
    from framewright.sources import payloads as p

    rows = [(1, b"abc", -1.0), (2, struct.pack("<I2f", 2, 0.5, 2.0) + b"zz", 0.0), (3, b"q", 0.25)]
    got = [(r.kind, r.scales, bytes(r.data)) for r in p.scales(spark.createDataFrame(rows, "k int, payload binary, scale float"), "k").orderBy("k").collect()]
    assert got == [("lossless", None, b"abc"), ("channel", [0.5, 2.0], b"zz"), ("global", [0.25], b"q")]


def test_psnr_of_matched_images(spark):
    rows = [("a", True, [0.0, 1.0], [0.0, 1.0]), ("b", True, [0.0, 1.0], [0.1, 0.9]), ("c", True, None, [0.1, 0.9]), ("d", False, [0.0], [0.5]), ("e", True, [2.0, -1.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "n string, image boolean, o array<double>, r array<double>")
    got = {r.n: (r.psnr, r.verdict) for r in pl.psnr_report(df, "o", "r", F.col("image")).collect()}
    assert got["a"] == (math.inf, "Great.") == got["e"] and got["b"][0] == pytest.approx(20.0) and got["b"][1] == "Acceptable." and got["c"] == got["d"] == (None, None)


def test_payloads():
    assert container.read_native_bitstream(container.native_bitstream([[b"a", b""], []], 3, 4)) == ([[b"a", b""], []], 3, 4)
    p = container.read_semantic_payload(container.semantic_payload(1, 16000, 1.5, 1, "hé", [0.5, -1.0], 150.0, 0.0, -20.0))
    assert p["transcript"] == "hé" and p["embedding"] == [0.5, -1.0] and p["duration_s"] == 1.5
    v = container.read_video_payload(container.video_payload(1, (128, 128), (100, 90), 24.0, 10, [(0, 8, b"x"), (8, 2, b"")]))
    assert v["chunks"] == [(0, 8, b"x"), (8, 2, b"")] and v["fps"] == 24.0


def test_file_scan(spark, tmp_path):
    for n in ("b.PNG", "a.mp3", "c.txt"):
        (tmp_path / n).write_bytes(b"12")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.wav").write_bytes(b"1")
    assert [(r.name, r.modality) for r in files.scan(spark, str(tmp_path)).collect()] == [("a.mp3", "audio"), ("b.PNG", "image")]
    with pytest.raises(Exception, match="unsupported"):
        files.single(spark, str(tmp_path / "c.txt")).collect()


def test_model_catalogue(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"b": {"type": "encodec", "sample_rate": 24000, "local_path": "x/b"}, "a": {"type": "compressai", "quality": 2}}')
    models = pl.catalogue(spark, str(tmp_path / "m.json"))
    assert [r.id for r in models.collect()] == ["a", "b"]
    there = spark.createDataFrame([("x/b",)], "path string")
    assert {r.id: r.cached for r in pl.listed(models, there).collect()} == {"a": False, "b": True}
    assert one(spark, e=pl.expert_id(F.lit("compressai"), F.lit(3)))["e"] == "img_mbt2018_q3"


def test_matching(spark):
    entries = spark.createDataFrame([(0, "a.png"), (1, "b.png")], "entry_idx int, name string")
    originals = spark.createDataFrame([("x/a.png",), ("y/c.wav",)], "path string")
    assert [(r.entry_idx, r.original) for r in pl.match_originals(entries, originals).orderBy("entry_idx").collect()] == [(0, "x/a.png"), (1, None)]
    recovered = spark.createDataFrame([("r/2.png",), ("r/1.png",)], "path string")
    assert [(r.path, r.recovered) for r in pl.first_by_extension(originals, recovered).collect()] == [("x/a.png", "r/1.png")]


def test_streams(spark, data, tmp_path):
    from framewright.session import table
    from framewright.streaming import streams

    events = table(spark, data, "events")
    events.write.parquet(str(tmp_path / "in"))
    t = streams.file_stream(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " "))
    q = streams.fill_forward(t.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))).writeStream.format("memory").queryName("filled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("filled").count() == events.count() and spark.table("filled").filter("filled is null").count() == 0
    q = streams.windowed_levels(t).writeStream.format("memory").queryName("levels").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("levels").agg(F.sum("n")).first()[0] == events.count()


def test_inner_layouts(spark):
    from framewright.sources import payloads as p

    codes = np.arange(12, dtype=np.int16).reshape(3, 4)
    for layer, fields in ((p.PLAIN, {}), (p.PROJECTED, {"seed": 5, "chunk": 128, "n_proj": 64, "bits": b"ab", "hf_n_proj": 32, "hf_bits": b"c"}), (p.LOSSLESS, {"residual": np.array([1, -2], np.int16)})):
        back = p.read_audio_payload(p.audio_payload(codes, layer, **fields))
        assert (back["codes"] == codes).all() and back["layer"] == layer
        assert all(np.array_equal(back[k], v) for k, v in fields.items())
    first = struct.pack("<BI", 3, 4) + p._zstd(codes.tobytes())
    assert (p.read_audio_payload(first)["codes"] == codes).all()
    x = np.random.default_rng(0).standard_normal((50, 30)) * 0.3
    back = p.read_polar_payload(p.polar_payload(x, 8, 8))
    assert np.abs(back[:, :24] - x[:, :24]).max() <= np.abs(x).max() / 127 and np.abs(back - x).max() < 0.1
    frames = [(0, 0, 0, b"i"), (1, 1, 0, b""), (4, 1, 0, b"pp")]
    data = p.legacy_video(frames, (64, 48), 2, 5, seed=9)
    assert p.read_legacy_video(data)["frames"] == frames
    rows = p.legacy_frames(spark.createDataFrame([("f", data)], "file string, payload binary")).collect()
    assert [(r.frame_idx, r.seed, bytes(r.data)) for r in rows] == [(0, 9, b"i"), (1, 8, b""), (4, 13, b"pp")]
