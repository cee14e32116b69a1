"""Literal goldens, inverse pairs and edge cases of tiles, scans and codes."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import bits, serial
from tessera.operators import checks, decode, mux, rice, scans, tiles
from tessera.plans import codec
from tessera.sources import generators, images
from tessera.streaming import frames


def seq(spark, values, img=0):
    return spark.createDataFrame([(img, i, v) for i, v in enumerate(values)], "img long, i long, v long")


def values(df, column="v"):
    return [r[column] for r in df.orderBy("i").collect()]


def plane(spark, width, cells):
    return spark.createDataFrame([(0, i // width, i % width, v) for i, v in enumerate(cells)], "img long, y long, x long, v int")


def test_delta_golden(spark):
    given = [1, 2, 4, 7, 11, 16, 23, 31]
    d = scans.delta(seq(spark, given))
    assert values(d, "d") == [1, 1, 2, 3, 4, 5, 7, 8]
    assert values(scans.undelta(d)) == given


def test_delta_wraps_and_crosses_pieces(spark, monkeypatch):
    monkeypatch.setattr(scans, "PIECE", 7)
    rng = random.Random(3)
    given = [rng.randrange(256) for _ in range(100)]
    d = scans.delta(seq(spark, given))
    assert values(d, "d") == [(v - p) % 256 for v, p in zip(given, [0, *given])]
    assert values(scans.undelta(d)) == given
    assert values(scans.exclusive(seq(spark, given)), "sum") == [sum(given[:i]) % 256 for i in range(100)]
    assert values(scans.signed_undelta(scans.signed_delta(seq(spark, given)))) == given


def test_empty_sequences(spark):
    none = seq(spark, [1]).limit(0)
    assert scans.delta(none).count() == scans.inclusive(none).count() == checks.adler32(none).count() == 0
    assert tiles.tiles(tiles.grid(none)).count() == 0


def test_rising_delta_refuses_falling_values(spark):
    with pytest.raises(Exception, match="do not rise"):
        scans.rising_delta(seq(spark, [3, 2])).collect()
    with pytest.raises(Exception, match="do not rise"):
        scans.rising_delta(seq(spark, [3, 3]), True).collect()
    assert values(scans.rising_delta(seq(spark, [3, 3, 5])), "d") == [3, 0, 2]


def test_zigzag_all_bytes(spark):
    df = spark.range(-128, 128).select("id", bits.zigzag("id").alias("z"))
    assert [r.z for r in df.where("id in (0, -1, 1, -2, 2, -128)").orderBy("z").collect()] == [0, 1, 2, 3, 4, 255]
    back = spark.range(256).select("id", bits.byte_unzigzag(bits.byte_zigzag("id")).alias("b"), bits.byte_zigzag("id").alias("z"), bits.byte_zigzag_by_mask("id").alias("m"))
    assert all(r.id == r.b and r.z == r.m for r in back.collect())


def test_split_pad_golden(spark):
    got = {(r.by, r.bx): r.cells for r in tiles.tiles(plane(spark, 3, [0, 1, 4, 2, 3, 5]), 2).collect()}
    assert got == {(0, 0): [0, 1, 2, 3], (0, 1): [4, 0, 5, 0]}
    flat = tiles.crop(tiles.cells_of(tiles.tiles(plane(spark, 3, [0, 1, 4, 2, 3, 5]), 2), 2), 3, 2)
    assert [r.v for r in flat.orderBy("y", "x").collect()] == [0, 1, 4, 2, 3, 5]


def test_block_delta_golden(spark):
    t = tiles.tiles(plane(spark, 2, [0, 1, 2, 3]), 2).select(tiles.delta_block("cells", 2).alias("d"))
    assert t.first().d == [0, 2, 4, 2]
    assert t.select(tiles.undelta_block("d", 2).alias("c")).first().c == [0, 1, 2, 3]


def test_visit_order_goldens(spark):
    order = lambda *a: [r.blocki for r in tiles.visit_order(*a, spark).orderBy("iter").collect()]
    assert order(8, 4, 2, 2) == [0, 1, 4, 5, 2, 3, 6, 7]
    assert order(64, 64, 8, 4)[::16] == [0, 4, 32, 36]
    assert sorted(order(16, 6, 2, 4)) == list(range(24))
    for width in range(4, 160, 12):
        assert sorted(order(width, 4, 2, 2)) == list(range(-(-width // 2) * 2))


def test_small_blocks_roundtrip(spark):
    t = tiles.tiles(generators.noise(spark, 64, 32)).withColumn("b", tiles.small_blocks("cells"))
    assert t.where(tiles.join_small("b") != F.col("cells")).count() == 0
    assert t.count() == 2


def test_half_block_layout_golden(spark):
    df = spark.createDataFrame([(0, 7, [0, 1, 2, 3]), (1, 8, [4, 5, 6, 7])], "blocki long, k int, syms array<int>")
    assert [(r.k, r.syms) for r in tiles.halves(df).orderBy("blocki", "half").collect()] == [(7, [0, 1]), (7, [2, 3]), (8, [4, 5]), (8, [6, 7])]


def test_column_row_sum_golden(spark):
    cells = [0] * 1024
    cells[1], cells[32], cells[33], cells[64] = 1, 1, 255, 255
    got = {(r.y, r.x): r.v for r in scans.column_row_sum(plane(spark, 32, cells), zigzag=False).collect()}
    v = np.array(cells).reshape(32, 32)
    v[:, 0] = np.cumsum(v[:, 0])
    assert got == {(y, x): int(s) % 256 for (y, x), s in np.ndenumerate(np.cumsum(v, axis=1))}


def _blocks(rng, n):
    made = []
    for i in range(n):
        top = rng.choice([2, 9, 40, 256])
        syms = [rng.randrange(top) for _ in range(32)]
        if i % 3 == 0:
            syms[rng.randrange(32)] = 255
        made.append((i, i % 8, syms))
    return made


def test_every_code_roundtrips_at_every_k(spark):
    rng = random.Random(5)
    made = _blocks(rng, 64)
    df = spark.createDataFrame(made, "i long, k int, syms array<int>")
    wanted = [s for _, _, s in made]

    def read(out):
        return [r.syms for r in out.orderBy("i").collect()]

    grouped = df.select("i", "k", rice.grouped_bits("syms", "k").alias("bits"), rice.cost("syms", "k").alias("cost"))
    assert read(decode.decode_grouped(grouped, 32)) == wanted
    assert grouped.where("length(bits) <> cost").count() == 0
    assert read(decode.decode_interleaved(df.select("i", "k", rice.interleaved_bits("syms", "k").alias("bits")), 32)) == wanted
    assert read(decode.decode_plain(df.select("i", "k", rice.plain_bits("syms", "k").alias("bits")), 32)) == wanted
    two = df.select("i", "k", rice.split_prefix_bits("syms", "k").alias("first"), rice.split_suffix_bits("syms", "k").alias("second"))
    assert read(decode.decode_split(two, 32)) == wanted


def test_best_k_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([([0] * 64,), ([1] * 64,), ([255] * 64,)], "syms array<int>")
    brute = []
    for s in ([0] * 64, [1] * 64, [255] * 64):
        cost = [sum(24 if n >> k >= 16 else (n >> k) + 1 + k for n in s) for k in range(8)]
        brute.append(cost.index(min(cost)))
    assert [r.k for r in df.select(rice.best_k("syms").alias("k")).collect()] == brute


def test_empty_block_has_no_bits(spark):
    df = spark.createDataFrame([([],)], "syms array<int>")
    assert df.select(rice.grouped_bits("syms", F.lit(2)).alias("b")).first().b == ""


def test_adler_closed_form(spark):
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    assert checks.adler32(seq(spark, list(data))).first().adler == zlib.adler32(data, 0)
    assert checks.adler32(seq(spark, [0, 0])).first().adler == 0xFFFFFFFF


def test_little_endian_eight_bytes(spark):
    big = 2**64 - 2
    df = spark.createDataFrame([(str(big),)], "s string").select(F.col("s").cast("decimal(20,0)").alias("n"))
    got = df.select(serial.little("n", 8).alias("b"), serial.read_little(serial.little("n", 8), F.lit(0), 8).alias("n")).first()
    assert bytes(got.b) == big.to_bytes(8, "little") and int(got.n) == big


def test_serial_empty_and_odd(spark):
    df = spark.createDataFrame([([],), ([1, 2, 3],)], "a array<int>")
    rows = df.select(serial.counted("a").alias("c"), serial.nibbles("a").alias("n"), serial.counted_bits("a").alias("b"), serial.read_counted_bits(serial.counted_bits("a")).alias("r"), serial.split_runs("a", 2).alias("s")).collect()
    assert bytes(rows[0].c) == b"\0\0\0\0" and rows[0].n == [] and rows[0].r == [] and rows[0].s == []
    assert bytes(rows[1].c) == b"\3\0\0\0\1\2\3" and rows[1].n == [0x21, 3] and bytes(rows[1].b) == b"\3\0\0\0\7" and rows[1].s == [[1, 2], [3]]


def test_bit_reader_golden():
    lanes = decode.Lanes([bytes(range(16))], np.array([6]))
    assert lanes.peek()[0] == int.from_bytes(bytes(range(6)), "big") >> 10 & 0xFFFFFFFF
    words = decode.Lanes([codec.unframe(bytes([3, 2, 1, 0, 7, 6, 5, 4]))])
    assert words.peek()[0] == 0x00010203


@pytest.mark.parametrize("width,height", [(1, 1), (32, 32), (70, 45), (33, 64), (256, 8)])
def test_codec_roundtrip(width, height):
    rng = np.random.default_rng(width)
    data = (np.cumsum(rng.normal(0, 9, width * height)).astype(np.int64) % 256).astype(np.uint8).tobytes()
    ks, offsets, n_bits, words = codec.encode_one(data, width, height)
    assert codec.decode_one(ks, offsets, words, width, height) == data
    assert len(words) == 4 * -(-(-(-n_bits // 8) + 4) // 4) + 4 and ks[-1] == 0


def test_codec_bands(spark):
    rng = np.random.default_rng(2)
    data = bytearray(rng.integers(0, 256, 40 * 100, dtype=np.uint8).tobytes())
    df = spark.createDataFrame([(1, 40, 100, data)], "img long, width int, height int, data binary")
    cut = codec.bands(df, 64)
    assert [(r.band, r.height) for r in cut.orderBy("band").collect()] == [(0, 64), (1, 36)]
    keyed = cut.select(F.col("band").cast("long").alias("img"), "width", "height", "data")
    back = codec.decode(codec.encode(keyed)).orderBy("img").collect()
    assert b"".join(bytes(r.data) for r in back) == bytes(data)


def test_mux_order_feeds_all_decoders():
    rng = random.Random(9)
    streams, wanted = [], []
    for s in range(3):
        syms = [rng.choice([rng.randrange(8), rng.randrange(256)]) for _ in range(20)]
        text = "".join("0" * 16 + f"{n:08b}" if n >> 2 >= 16 else "0" * (n >> 2) + "1" + f"{n & 3:02b}" for n in syms)
        streams.append(decode.pack_text(text) + b"\0" * 4)
        wanted.append(syms)
    joined = mux.multiplex(streams, [[2]] * 3, 20, 20)
    assert mux.demultiplex(joined, [[2]] * 3, 20, 20) == wanted


@pytest.mark.parametrize("unit", [1, 8])
def test_mux_groups_of_different_sizes(unit):
    """Many groups at once, k by block, against a reader that takes one symbol after another."""
    rng = random.Random(unit)
    groups, kss, wanted = [], [], []
    for size in (1, 3, 2, 3, 4):
        streams, ks, symbols = [], [], []
        for _ in range(size):
            k = [rng.randrange(8) for _ in range(3)]
            syms = [rng.choice([rng.randrange(8), rng.randrange(256)]) for _ in range(20)]
            code = lambda n, k: "0" * 16 + f"{n:08b}" if n >> k >= 16 else "0" * (n >> k) + "1" + (f"{n & ((1 << k) - 1):0{k}b}" if k else "")
            streams.append(decode.pack_text("".join(code(n, k[j // 8]) for j, n in enumerate(syms))))
            ks.append(k)
            symbols.append(syms)
        groups.append(streams)
        kss.append(ks)
        wanted.append(symbols)
    muxes = mux.multiplex_many(groups, kss, 20, 8, unit)
    assert [f.tolist() for f in mux.demultiplex_many(muxes, kss, 20, 8, unit)] == wanted
    assert muxes == [mux.multiplex(g, ks, 20, 8, unit) for g, ks in zip(groups, kss)]
    for streams, ks, syms, got in zip(groups, kss, wanted, muxes):  # the order in which bits are asked for
        used, read, order = [0] * len(streams), [0] * len(streams), bytearray()
        for j in range(20):
            for s, data in enumerate(streams):
                k, n = ks[s][j // 8], syms[s][j]
                for bits in ((16, 8) if n >> k >= 16 else ((n >> k) + 1, k)):
                    while 8 * unit * read[s] - used[s] <= mux.LOW:
                        order += data[read[s] * unit : (read[s] + 1) * unit].ljust(unit, b"\0")
                        read[s] += 1
                    used[s] += bits
        assert got == bytes(order)


def test_numbers_and_sums_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(scans, "PIECE", 10)
    monkeypatch.setattr(rice, "PIECE", 3)
    rng = random.Random(2)
    ids = sorted(rng.sample(range(500), 90))
    rows = spark.createDataFrame([(i % 2, i) for i in ids], "img long, v long")
    got = {(r.img, r.v): r.i for r in scans.numbered(rows, "img", "v", "i").collect()}
    assert got == {(g, v): j for g in (0, 1) for j, v in enumerate([i for i in ids if i % 2 == g])}
    widths = [(g, b, s, rng.randrange(9)) for g in (0, 1) for b in range(11) for s in range(4)]
    sums = rice.offsets_of(spark.createDataFrame(widths, "img long, by long, s long, w long"), "w", ["by", "s"]).collect()
    for r in sums:
        assert r.bit_offset == sum(w for g, b, s, w in widths if g == r.img and (b, s) < (r.by, r.s))


def test_k_table_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rice, "PART", 4)
    rows = spark.createDataFrame([(g, i, (i * 3 + g) % 8) for g in (0, 1) for i in range(8 + g)], "img long, blocki long, k int")
    got = {(r.img, r.part): bytes(r.ks) for r in rice.k_table(rows).collect()}
    for g in (0, 1):
        assert b"".join(got[g, p] for p in sorted(p for i, p in got if i == g)) == bytes([(i * 3 + g) % 8 for i in range(8 + g)]) + b"\0"
    assert max(map(len, got.values())) == 4


def test_a_place_given_twice_is_an_error(spark):
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        tiles.tiles(plane(spark, 2, [1, 2]).union(plane(spark, 2, [1, 2]))).collect()


def filtered(px, how):
    """Rows of a PNG under the filters ``how``, by the definition of each."""
    height, width, step = px.shape
    rows = []
    for y in range(height):
        row = [how[y]]
        for x in range(width):
            for c in range(step):
                a = int(px[y, x - 1, c]) if x else 0
                b = int(px[y - 1, x, c]) if y else 0
                d = int(px[y - 1, x - 1, c]) if x and y else 0
                near = a + b - d
                paeth = min((a, b, d), key=lambda v: abs(near - v))
                row.append((int(px[y, x, c]) - [0, a, b, (a + b) // 2, paeth][how[y]]) % 256)
        rows.append(row)
    return np.array(rows, np.uint8)


def test_png_filters():
    rng = np.random.default_rng(3)
    px = np.cumsum(rng.integers(-3, 4, (13, 9, 4)), axis=1).astype(np.uint8)
    for how in ([0, 1, 2, 1, 2, 0, 2, 1, 0, 0, 1, 2, 2], rng.integers(0, 5, 13).tolist(), [4] * 13, [3] * 13):
        assert (images._unfiltered(filtered(px, how), 9, 4).reshape(px.shape) == px).all()


def test_files_that_give_no_image_say_why(spark, tmp_path):
    bgra = bytes(range(48)) * 2
    good = {kind: make(bgra, 6, 4) for kind, make in (("png", images.to_png), ("bmp", images.to_bmp), ("tiff", images.to_tiff), ("tga", images.to_tga))}
    for kind, data in good.items():
        (tmp_path / f"a.{kind}").write_bytes(data)
        (tmp_path / f"cut.{kind}").write_bytes(data[: len(data) // 2])
    (tmp_path / "x.txt").write_bytes(b"no image at all, only a text of some length")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert len(rows) == 9
    for name, r in rows.items():
        if name.startswith("a."):
            assert (r.width, r.height, bytes(r.bgra), r.bits, r.reason) == (6, 4, bgra, 32, None)
        else:
            assert r.width is None and r.bgra is None and r.reason
    assert images.decoded(b"")[0] is None and images.decoded(None)[4]
    assert images.decoded(images.to_png(b"\1\2\3\xff" * 6, 3, 2))[3] == 24


def test_image_formats(spark, tmp_path):
    rng = np.random.default_rng(4)
    bgra = rng.integers(0, 256, (37, 53, 4), dtype=np.uint8).tobytes()
    assert images.from_png(images.to_png(bgra, 53, 37)) == (53, 37, bgra)
    assert images.from_bmp(images.to_bmp(bgra, 53, 37)) == (53, 37, bgra)
    assert images.unlzw(images.lzw(bgra)) == bgra and images.unlzw(images.lzw(b"ab" * 9000)) == b"ab" * 9000
    assert images.from_tiff(images.to_tiff(bgra, 53, 37)) == (53, 37, bgra) and images.from_tga(images.to_tga(bgra, 53, 37)) == (53, 37, bgra)
    tga = bytes([0, 0, 2]) + bytes(9) + (53).to_bytes(2, "little") + (37).to_bytes(2, "little") + bytes([32, 32]) + bgra
    assert images.decode_file(tga) == (53, 37, bgra)
    (tmp_path / "a.png").write_bytes(images.to_png(bgra, 53, 37))
    (tmp_path / "b.tga").write_bytes(tga)
    got = images.read_images(spark, str(tmp_path)).collect()
    assert len(got) == 2 and all((r.width, r.height, bytes(r.bgra)) == (53, 37, bgra) for r in got)
    assert images.file_sizes(spark, str(tmp_path)).where("length > 0").count() == 2


def test_streamed_frames(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, 32, 32, bytearray(rng.integers(0, 256, 1024, dtype=np.uint8).tobytes())) for i in range(5)]
    df = spark.createDataFrame(rows, "img long, width int, height int, data binary")
    codec.encode(df).repartition(3).write.parquet(str(tmp_path / "in"))
    q = frames.write_frames(frames.decoded_frames(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("img").collect()
    assert [bytes(r.data) for r in got] == [bytes(r[3]) for r in rows]


def test_generators(spark):
    assert [r.v for r in generators.frame(spark, "32x32_delta_ident").orderBy("y", "x").limit(5).collect()] == [0, 1, 3, 6, 10]
    assert generators.frame(spark, "grid_6x4").count() == 24
    first = generators.noise(spark, 16, 16)
    assert first.exceptAll(generators.noise(spark, 16, 16).repartition(7)).isEmpty()


def test_first_differences(spark):
    a, b = seq(spark, [1, 2, 3]), seq(spark, [1, 5])
    assert [(r.i, r.left_v, r.right_v) for r in checks.first_differences(a, b, ["img", "i"]).collect()] == [(1, 2, 5), (2, 3, None)]


def test_sql_functions(spark):
    from tessera.functions import registry

    registry.register(spark)
    made = _blocks(random.Random(8), 12)
    df = spark.createDataFrame([*made], "i long, k int, syms array<int>")
    coded = df.select("*", rice.grouped_bits("syms", "k").alias("bits"))
    spark.createDataFrame(coded.collect(), coded.schema).createOrReplaceTempView("coded")
    assert spark.sql("select * from coded where rice_decode(bits, k, 32, 'grouped') <> syms").count() == 0
    got = spark.sql("select c.i, s.i as j, s.v from coded c, lateral rice_symbols(c.bits, c.k, 32, 'grouped') s order by c.i, j").collect()
    assert [r.v for r in got] == [v for _, _, syms in made for v in syms]
    best = spark.sql("select i, rice_k(v) as best, rice_bits(v) as bits from (select i, explode(syms) as v from coded) group by i").collect()
    plain = df.select("i", rice.best_k("syms").alias("k"), F.array_min(rice.costs("syms")).alias("bits"))
    assert {(r.i, r.best, r.bits) for r in best} == {(r.i, r.k, r.bits) for r in plain.collect()}


def test_stored_relations(spark, tmp_path):
    df = spark.createDataFrame([(1, 32, 32, bytearray(range(256)) * 4)], "img long, width int, height int, data binary")
    codec.write_relations(codec.encode(df), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 16 and spark.read.parquet(str(tmp_path / "offsets")).count() == 32
