import math
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.functions import codecs, kernels
from sedimenta.functions import constants as C
from sedimenta.operators import archive, chunking, folds, ordering, planning
from sedimenta.sources import container, files
from sedimenta.streaming import ingest

EDGES = [b"", b"a", b"ab", b"abc", b"abcd", b"x" * 31, b"x" * 32, b"x" * 63, b"x" * 64, b"x" * 65, bytes(range(256)), bytes(range(256)) * 9]


@pytest.mark.parametrize("b", EDGES)
def test_kernels_by_definition(b):
    n = Counter(b)
    assert kernels.entropy(b) == pytest.approx(-sum(k / len(b) * math.log2(k / len(b)) for k in n.values()) / 8 if b else 0.0)
    assert kernels.distinct_pairs(b) == (len({b[i : i + 2] for i in range(len(b) - 1)}) / (len(b) - 1) if len(b) > 1 else 1.0)
    seen, repeats, total = set(), 0, 0
    for i in range(0, len(b) - 31, 4):
        repeats, total = repeats + (b[i : i + 32] in seen), total + 1
        seen.add(b[i : i + 32])
    assert kernels.motif_score(b) == pytest.approx(repeats / total if len(b) >= 64 else 0.0)
    votes = [0] * 64
    for i in range(0, min(len(b), 8192) - 3, 4):
        h = zlib.crc32(b[i : i + 4], 0xFFFFFFFF) << 32 | zlib.crc32(b[i : i + 4])
        votes = [v + (1 if h >> k & 1 else -1) for k, v in enumerate(votes)]
    assert kernels.simhash(b) == (sum(1 << k for k, v in enumerate(votes) if v >= 0) if b else 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"abcdefgh" * 4, b"01234567" * 5, b"x", b"\0\1"]), max_size=12), st.binary(max_size=80))
def test_codecs_give_back_what_they_took(parts, tail):
    data = b"".join(parts) + tail
    motifs = [m for m, _, _ in codecs.top_motifs(data)]
    assert codecs.motif_decode(codecs.motif_encode(data, motifs), motifs, len(data)) == data
    assert codecs.delta_decode(codecs.delta_encode(data, data[3:] + tail), data[3:] + tail, len(data)) == data
    for codec in (C.CODEC_STORE, C.CODEC_ZSTD, C.CODEC_ZLIB):
        assert codecs.decompress(codecs.compress(data, codec), codec, len(data)) == data


@given(st.integers(0, 2**62))
def test_uvarint(n):
    assert codecs.get_uvarint(codecs.put_uvarint(n)) == (n, max(1, -(-n.bit_length() // 7)))


def test_bits():
    fields = [(1, 1), (1, 2), (5, 3), (240, 8), (0, 1), (0xABCD, 16)]
    assert codecs.unpack_bits(codecs.pack_bits(fields), [w for _, w in fields]) == [v for v, _ in fields]


def test_damage_is_reported():
    with pytest.raises(ValueError):
        codecs.motif_decode(b"\0\5ab", [], 5)
    with pytest.raises(ValueError):
        codecs.delta_decode(b"\1\0\5", b"abc", 5)


def _files(spark, contents):
    rows = [(i, f"a/b/{i}.txt", "txt", len(c), bytearray(c)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "file_index long, path string, ext string, raw_size long, content binary")


def test_dedupe_and_verify(spark):
    f = _files(spark, [b"a" * 8 + b"b" * 8, b"", b"b" * 8 + b"c" * 3, b"a" * 8])
    rows = {r.file_index: r for r in chunking.dedupe_report(f, 8).collect()}
    assert [(rows[i].chunks, rows[i].new_chunks, rows[i].new_bytes) for i in range(4)] == [(2, 2, 16), (0, 0, 0), (2, 1, 3), (1, 0, 0)]
    built = archive.build(f, 8)
    assert all(r.ok for r in archive.verify(built).collect())
    broken = built._replace(blocks=built.blocks.where("block_id <> 1"))
    assert {r.file_index for r in archive.verify(broken).collect() if not r.ok} == {0, 3}


def test_container_round_trip(spark, tmp_path):
    f = _files(spark, [b"a" * 100, b"", b"b" * 50 + b"a" * 100])
    target = f"{tmp_path}/x.archive"
    container.write(archive.build(f, 64), target)
    back = container.read(spark, target)
    assert all(r.ok for r in archive.verify(back).collect())
    assert {r.tag: r.n for r in container.info(back).collect()}["CHNK"] >= 2
    out = f"{tmp_path}/out"
    container.extract(back, out)
    assert open(f"{out}/a/b/2.txt", "rb").read() == b"b" * 50 + b"a" * 100
    with pytest.raises(ValueError):
        container.parse(open(target, "rb").read()[:-30])


def test_scan_keeps_empty_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/.bashrc").write_bytes(b"x")
    (tmp_path / "d/A.TXT").write_bytes(b"")
    assert {(r.path.rsplit("/", 1)[1], r.raw_size, r.ext) for r in files.scan(spark, str(tmp_path)).collect()} == {(".bashrc", 1, ""), ("A.TXT", 0, "txt")}


def test_fold_blocks_do_not_matter(spark):
    gains = spark.range(500).selectExpr("'g' AS grp", "id AS idx", "(id * 37 % 101) / 400.0D AS gain")
    small, whole = folds.adaptive_bias(gains, 7).first(), folds.adaptive_bias(gains, 10_000).first()
    assert (small.n, round(small.ema, 9), round(small.bias, 9)) == (whole.n, round(whole.ema, 9), round(whole.bias, 9))


def test_running_total(spark):
    df = spark.range(100).selectExpr("id", "id % 3 AS v")
    assert [r.t for r in ordering.running_total(df, "v", "id", "t", width=9).orderBy("id").collect()] == [sum(i % 3 for i in range(k)) for k in range(100)]


def test_ingest_stream(spark, tmp_path):
    f = _files(spark, [b"a" * 16, b"b" * 8])
    f.write.parquet(f"{tmp_path}/in")
    q = ingest.new_chunks(spark.readStream.schema(f.schema).parquet(f"{tmp_path}/in"), 8).writeStream.format("memory").queryName("new_chunks").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("new_chunks").count() == 2


def test_features_of_media_and_observed_gain(spark):
    media = bytes(70_000) + bytes((i * i + i // 251) % 256 for i in range(70_000)) + b"ab" * 40_000
    rows = [(0, "png", media), (1, "txt", media), (2, "mp4", b""), (3, "zip", b"PK\x03\x04" + b"x" * 50), (4, "txt", b"same text " * 900), (5, "txt", b"same text " * 900), (6, None, None)]
    df = spark.createDataFrame([(i, f"p/{i}", e, len(b or b""), b) for i, e, b in rows], "file_index long, path string, ext string, raw_size long, content binary")
    out = {r.file_index: r for r in planning.features(df).collect()}
    at = [media[o : o + C.PROBE_BYTES] for o in (0, len(media) // 4, len(media) * 3 // 4)]
    gain = lambda b: 1 - len(zlib.compress(b, 1)) / len(b) if b else 0.0
    assert out[0].entropy == pytest.approx(sum(map(kernels.entropy, at)) / 3) and out[0].uniq == pytest.approx(sum(map(kernels.distinct_pairs, at)) / 3) and out[0].gain == pytest.approx(min(map(gain, at)))
    assert out[1].entropy == pytest.approx(kernels.entropy(at[0])) and out[1].gain == pytest.approx(gain(at[0])) and out[0].pi_hash64 == out[1].pi_hash64
    assert (out[2].entropy, out[2].gain, out[2].is_container, out[3].is_container, out[6].is_container) == (0.0, 0.0, True, True, False)
    plans = {r.file_index: r for r in planning.planned(planning.features(df)).collect()}
    assert len(plans) == 7 and plans[2].action == "WHOLE" and {p.action for p in plans.values()} <= {"WHOLE", "CDC", "DNA", "PI"}
    built = archive.build(df, chunk_size=4096)
    gains = {r.file_index: r for r in planning.observed_gains(built).collect()}
    cost = sum(68 + len(codecs.best_codec(rows[4][2][k : k + 4096])[1]) for k in range(0, 9000, 4096))
    assert gains[4].encoded == cost and gains[4].gain == pytest.approx(1 - cost / 9000) and gains[5].gain == 1.0 and gains[6].gain == 1.0


def test_state_before_each_row(spark):
    rows = [("a" if i % 3 else "b", i, (i * 37 % 101) / 500) for i in range(500)]
    found = {(r.grp, r.idx): (r.ema, r.bias) for r in folds.before_each(spark.createDataFrame(rows, "grp string, idx long, gain double"), block=16).collect()}
    for grp in "ab":
        ema, bias = 0.0, 0.0
        for _, i, g in [r for r in rows if r[0] == grp]:
            assert found[grp, i] == pytest.approx((ema, bias), abs=1e-12)
            ema = (1 - 0.12) * ema + 0.12 * g
            step = min(0.01, 0.05 * (0.06 - ema)) if ema < 0.06 else -min(0.01, 0.02 * (ema - 0.06))
            bias = max(-0.05, min(0.20, bias + step))
