"""Queries over stored tables for each group of operators, and SQL that says the same.

Arrays are shown as text, so that any engine compares them alike.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, pixels, serial
from .operators import checks, decode, mux, rice, scans, tiles
from .plans import codec
from .sources import generators, images, relations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that says the same."""
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def text(a: Column | str) -> Column:
    return F.array_join(F.transform(F.col(a) if isinstance(a, str) else a, lambda v: v.cast("string")), ",")


# ---- pieces of SQL

PX = """px as (select user_id as img, row_number() over (partition by user_id order by event_id) - 1 as i,
  cast(floor(value) as bigint) % 256 as v from events)"""
BYTES = "bv as (select distinct cast(floor(value) as bigint) % 256 as v from events)"
DENSE = PX + """,
nt as (select distinct img, i // 1024 as b from px),
g as (select nt.img, nt.b, o, coalesce(px.v, 0) as v from nt cross join (select unnest(range(1024)) as o) left join px on px.img = nt.img and px.i = nt.b * 1024 + o)"""
DELTA = DENSE + """,
du as (select *, ((v - case when o % 32 = 0 then lag(v, 32) over w else lag(v, 1) over w end) % 256 + 256) % 256 as u from g
  window w as (partition by img, b order by o)),
d as (select img, b, o, case when o = 0 then v when u >= 128 then 511 - 2 * u else 2 * u end as z from du)"""
SMALL = DELTA + """,
sb as (select img, b, (o // 256) * 4 + (o % 32) // 8 as s, ((o // 32) % 8) * 8 + o % 8 as so, z as v from d)"""
COST = "case when (v >> k) >= 16 then 24 else (v >> k) + 1 + k end"
BESTK = SMALL + f""",
ck as (select img, b, s, k, sum({COST}) as bits from sb cross join (select unnest(range(8)) as k) group by all),
bk as (select img, b, s, cast(min(bits * 8 + k) % 8 as bigint) as k from ck group by all)"""
EMBED = """em as (select vec_id as img, unnest(range(64)) as o, unnest(embedding) as e from embeddings),
sy as (select img, o, cast(greatest(0, least(255, floor((cast(e as double) + 1) * 127.5))) as bigint) as v from em)"""
CODED = EMBED + f""",
ce as (select img, k, sum({COST}) as bits from sy cross join (select unnest(range(8)) as k) group by all),
be as (select img, cast(min(bits * 8 + k) % 8 as bigint) as k from ce group by all),
cd as (select img, o, v, k, case when (v >> k) >= 16 then repeat('0', 16) || left(lpad(bin(v), 8, '0'), cast(8 - k as int)) else repeat('0', cast(v >> k as int)) || '1' end as p,
  case when k > 0 then right(lpad(bin(v), 8, '0'), cast(k as int)) else '' end as q, (v >> k) >= 16 as esc from sy join be using (img))"""


def _events_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.two_stage(tiles.grid(relations.px_events(spark, sf_dir)))


def _best(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("k", rice.best_k("syms"))


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 blocks with their best k."""
    return _best(relations.px_embed(spark, sf_dir))


# ---- the flagship

@query(f"""with {BESTK},
w as (select bk.img, sum({COST}) as bits, count(*) as n from sb join bk using (img, b, s) group by 1)
select img, cast(n as bigint) as raw_bytes, cast(bits as bigint) as coded_bits, cast(ceil(bits / 8.0) as bigint) as coded_bytes, round(n / ceil(bits / 8.0), 6) as ratio from w""")
def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes to deltas, best k and coded size, by user."""
    bits_ = F.array_min(rice.costs("syms")).cast("long")
    sized = _events_tiles(spark, sf_dir).select("img", bits_.alias("bits"), F.size("syms").alias("n"))
    coded = F.ceil(F.sum("bits") / 8)
    return sized.groupBy("img").agg(
        F.sum("n").cast("long").alias("raw_bytes"), F.sum("bits").cast("long").alias("coded_bits"), coded.cast("long").alias("coded_bytes"),
        F.round(F.sum("n") / coded, 6).alias("ratio"),
    )


# ---- scalar functions

@query(f"""with {BYTES}, s as (select v, v - 128 as n from bv)
select v, case when n < 0 then -2 * n - 1 else 2 * n end as z, n as back, case when v >= 128 then 511 - 2 * v else 2 * v end as bz, v as bback,
  case when v >= 128 then 511 - 2 * v else 2 * v end as masked from s""")
def zigzag_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C02 to C06."""
    v = relations.px_events(spark, sf_dir).select(F.col("v").cast("long").alias("v")).distinct()
    n = F.col("v") - 128
    return v.select("v", bits.zigzag(n).alias("z"), bits.unzigzag(bits.zigzag(n)).alias("back"), bits.byte_zigzag("v").alias("bz"),
                    bits.byte_unzigzag(bits.byte_zigzag("v")).alias("bback"), bits.byte_zigzag_by_mask("v").alias("masked"))


@query(f"with {BYTES} select v, k, v >> k as q, {COST} as bits, (v >> k) + 1 + k as plain, (v >> k) >= 16 as escaped from bv cross join (select unnest(range(8)) as k)")
def rice_num_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C01, C07, C08, D06."""
    v = relations.px_events(spark, sf_dir).select(F.col("v").cast("long").alias("v")).distinct()
    rows = v.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k"))
    q = bits.shifted_right("v", "k")
    return rows.select("v", "k", q.alias("q"), bits.num_bits("v", "k").cast("long").alias("bits"), bits.num_bits_plain("v", "k").alias("plain"), (q >= 16).alias("escaped"))


@query(f"""with {BYTES} select v, case when v = 0 then 16 else 8 - length(bin(v)) + 8 end as clz, case when v % 40 >= 32 then 0 else (v << (v % 40)) % 4294967296 end as up,
  case when v % 40 >= 32 then 0 else v >> (v % 40) end as down, left(lpad(bin(v), 8, '0'), 4) || '-' || right(lpad(bin(v), 8, '0'), 4) as shown,
  greatest(16, least(235, v)) as clamped, least(v, 100, v * 3 % 256) as low3, greatest(v, 100, v * 3 % 256) as high3, (v + 7) // 8 as blocks, (v + 3) // 4 * 4 as padded from bv""")
def scalar_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C09 to C17."""
    v = relations.px_events(spark, sf_dir).select(F.col("v").cast("long").alias("v")).distinct()
    x, n = F.col("v"), F.col("v") % 40
    return v.select(
        "v", bits.leading_zeros(F.lpad(F.bin("v"), 16, "0")).cast("long").alias("clz"), bits.safe_shift_left(x, n).alias("up"), bits.safe_shift_right(x, n).alias("down"),
        bits.bit_text("v", 8).alias("shown"), bits.clamp("v", 16, 235).cast("long").alias("clamped"),
        F.least(x, F.lit(100).cast("long"), x * 3 % 256).alias("low3"), F.greatest(x, F.lit(100).cast("long"), x * 3 % 256).alias("high3"),
        bits.ceil_div("v", 8).alias("blocks"), bits.padded("v").alias("padded"),
    )


@query(f"""with {PX} select img, i, i % 32 as x, i // 32 as y, (i // 32) * 32 + i % 32 as back, 5 + i % 7 as rx, 9 + i // 7 as ry, cast(floor(v / 255.0 * 255 + 0.5) as bigint) as unit,
  cast(floor(v / 65535.0 * 65535 + 0.5) as bigint) as unit16, i % 32 as cell,
  4278190080 + v * 65536 + (v * 3 % 256) * 256 + i % 256 as pixel, v * 65793 + 4278190080 as gray, (299 * v + 587 * (v * 3 % 256) + 114 * (i % 256) + 500) // 1000 as luma,
  v * 65536 + (v * 3 % 256) * 256 + i % 256 as cleared, (i // 32) * 65536 + i % 32 as xy from px""")
def pixel_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20 to C31, H17."""
    px = relations.px_events(spark, sf_dir).withColumns({"b": F.col("i") % 256, "g": F.col("v").cast("long") * 3 % 256, "r": F.col("v").cast("long")})
    at, box = pixels.coords_of("i", F.lit(32)), pixels.relative_coords(5, 9, F.lit(7), "i")
    pixel = pixels.pack_bgra("b", "g", "r", F.lit(255))
    parts = px.select("*", pixel.alias("pixel"), at.alias("at"), box.alias("box")).withColumn("parts", pixels.unpack_bgra("pixel"))
    back = pixels.pack_bgra("parts.b", "parts.g", "parts.r", "parts.a")
    return parts.select(
        "img", "i", F.col("at.x").alias("x"), F.col("at.y").alias("y"), pixels.offset_of("at.x", "at.y", F.lit(32)).alias("back"), F.col("box.x").alias("rx"), F.col("box.y").alias("ry"),
        pixels.from_unit(pixels.to_unit("r")).alias("unit"), pixels.from_unit(pixels.to_unit("r", 65535), 65535).alias("unit16"),
        pixels.cell_of((F.col("at.x") + 0.5) / 32, F.lit(32)).alias("cell"), pixels.opaque(pixels.clear_alpha(back)).alias("pixel"),
        pixels.gray_pixel("v").alias("gray"), pixels.luma("r", "g", "b").cast("long").alias("luma"), pixels.clear_alpha("pixel").alias("cleared"), pixels.xy_pixel("at.x", "at.y").alias("xy"),
    )


@query("""with n as (select unnest(range(15)) as code, unnest(['NONE','TOPBOTTOM','LEFTRIGHT','4UP','LEFTRIGHTHALF','LEFTHALFRIGHT','TOPBOTTOMHALF','TOPHALFBOTTOM','L1','L2','L3','L4','END','CHECKERBOARD_BW_WB','CHECKERBOARD_WB_BW']) as s)
select code, case when code <> 12 then 'BLOCK_SUBDIVISION_TYPE_' || s end as name, case when code <> 12 then code end as back from n""")
def subdivision_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C32."""
    rows = spark.range(15).select(F.col("id").alias("code"), pixels.subdivision_name("id").alias("name"))
    return rows.withColumn("back", pixels.subdivision_code("name").cast("long"))


# ---- scans

@query(f"with {PX} select img, i, ((v - coalesce(lag(v) over (partition by img order by i), 0)) % 256 + 256) % 256 as d from px")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01, G07, G09."""
    return scans.delta(relations.px_events(spark, sf_dir)).withColumn("d", F.col("d").cast("long"))


@query(f"with {PX} select img, i, v from px")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deltas decoded are what was encoded."""
    return scans.undelta(scans.delta(relations.px_events(spark, sf_dir))).withColumn("v", F.col("v").cast("long"))


@query(f"""with {PX}, u as (select img, i, ((v - coalesce(lag(v) over (partition by img order by i), 0)) % 256 + 256) % 256 as u from px)
select img, i, case when u >= 128 then 511 - 2 * u else 2 * u end as d from u""")
def signed_byte_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10, encoding."""
    return scans.signed_delta(relations.px_events(spark, sf_dir)).withColumn("d", F.col("d").cast("long"))


@query(f"with {PX} select img, i, v from px")
def signed_byte_undelta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10, decoding."""
    return scans.signed_undelta(scans.signed_delta(relations.px_events(spark, sf_dir))).withColumn("v", F.col("v").cast("long"))


def _rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event ids in order, which rise."""
    events = relations.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("img"), F.col("event_id").cast("long").alias("v"))
    return scans.numbered(events, "img", "v", "i").select("img", "i", "v")


@query("""with e as (select user_id as img, row_number() over w - 1 as i, event_id as v, lag(event_id) over w as p from events window w as (partition by user_id order by event_id))
select img, i, case when i = 0 then v else v - p end as d, case when i = 0 then v else v - p - 1 end as d1, v as back, v as back1 from e""")
def plus_delta_minus_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G02, G03, G06, both ways, with and without the one taken off."""
    seq = _rising(spark, sf_dir)
    plain, less = scans.rising_delta(seq), scans.rising_delta(seq, True)
    out = plain.join(less.withColumnRenamed("d", "d1"), ["img", "i"])
    out = out.join(scans.rising_undelta(plain).withColumnRenamed("v", "back"), ["img", "i"])
    return out.join(scans.rising_undelta(less, True).withColumnRenamed("v", "back1"), ["img", "i"])


@query(f"with {PX} select img, i, cast(sum(v) over (partition by img order by i) % 256 as bigint) as sum from px")
def prefix_sum_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11."""
    return scans.inclusive(relations.px_events(spark, sf_dir))


@query(f"with {PX} select img, i, cast((sum(v) over (partition by img order by i) - v) % 256 as bigint) as sum from px")
def prefix_sum_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12, G20."""
    return scans.exclusive(relations.px_events(spark, sf_dir))


@query(f"with {PX} select img, i // 2 as i, cast(sum(v) % 256 as bigint) as v from px group by all")
def prefix_reduce_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    return scans.reduce_pairs(relations.px_events(spark, sf_dir))


@query(f"""with {PX}, r as (select img, i // 2 as i, sum(v) % 256 as v from px group by all)
select px.img, px.i, cast((r.v + case when px.i % 2 = 1 then lag(px.v) over (partition by px.img order by px.i) else 0 end) % 256 as bigint) as v from px join r on r.img = px.img and r.i = px.i // 2""")
def prefix_downsweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level down from the sums of pairs."""
    px = relations.px_events(spark, sf_dir)
    return scans.downsweep(scans.reduce_pairs(px), px)


# ---- blocks

@query(f"with {DENSE} select img, b as by, 0 as bx, string_agg(cast(v as varchar), ',' order by o) as cells from g group by all")
def block_split_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H01, H02, H05, H07, E06, C51."""
    t = tiles.tiles(tiles.grid(relations.px_events(spark, sf_dir)))
    return t.select("img", "by", "bx", text("cells").alias("cells"))


@query(f"with {PX}, m as (select img, max(i // 32) as rows from px group by 1) select img, i // 32 as y, i % 32 as x, v from px join m using (img) where i // 32 < rows and i % 32 < 30")
def block_flatten_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks back to planes, without the last row and two columns."""
    plane = tiles.grid(relations.px_events(spark, sf_dir))
    rows = plane.groupBy("img").agg(F.max("y").alias("rows"))
    flat = tiles.cells_of(tiles.tiles(plane), tiles.BIG).join(rows, "img")
    return tiles.crop(flat, 30, F.col("rows")).select("img", "y", "x", F.col("v").cast("long").alias("v"))


@query(f"with {DENSE} select img, b * 34 + o // 32 as y, o % 32 as x, v from g")
def block_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks two cells apart."""
    flat = tiles.cells_of(tiles.tiles(tiles.grid(relations.px_events(spark, sf_dir))), tiles.BIG)
    return tiles.spaced(flat).withColumn("v", F.col("v").cast("long"))


@query(f"with {PX} select img, i // 32 as y, i % 32 as x, v from px")
def drop_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that no value covers are marked, then dropped."""
    flat = tiles.cells_of(tiles.tiles(tiles.grid(relations.px_events(spark, sf_dir)), empty=-1), tiles.BIG)
    return tiles.drop_missing(flat, missing=-1).withColumn("v", F.col("v").cast("long"))


@query(f"with {DELTA} select img, b as by, 0 as bx, string_agg(cast(z as varchar), ',' order by o) as cells from d group by all")
def block_delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H08, J42."""
    t = tiles.tiles(tiles.grid(relations.px_events(spark, sf_dir)))
    return t.select("img", "by", "bx", text(tiles.delta_block("cells", tiles.BIG)).alias("cells"))


@query(f"with {DENSE} select img, b as by, 0 as bx, string_agg(cast(v as varchar), ',' order by o) as cells from g group by all")
def block_delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas summed again are the cells."""
    t = tiles.tiles(tiles.grid(relations.px_events(spark, sf_dir))).withColumn("d", tiles.delta_block("cells", tiles.BIG))
    return t.select("img", "by", "bx", text(tiles.undelta_block("d", tiles.BIG)).alias("cells"))


@query(f"with {SMALL} select img, b as by, 0 as bx, s, string_agg(cast(v as varchar), ',' order by so) as syms from sb group by all")
def two_stage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas on large blocks, cut into small ones."""
    return _events_tiles(spark, sf_dir).select("img", "by", "bx", F.col("s").cast("long").alias("s"), text("syms").alias("syms"))


@query(f"with {DENSE} select img, b * 32 + o // 32 as y, o % 32 as x, v from g")
def col_row_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows undo the deltas of whole planes."""
    t = tiles.tiles(tiles.grid(relations.px_events(spark, sf_dir))).select("img", "by", "bx", tiles.delta_block("cells", tiles.BIG).alias("cells"))
    return scans.column_row_sum(tiles.cells_of(t, tiles.BIG)).withColumn("v", F.col("v").cast("long"))


@query(f"""with {DENSE}, c as (select *, sum(case when o % 32 = 0 then v end) over (partition by img, b order by o) as col0 from g)
select img, b * 32 + o // 32 as y, o % 32 as x, cast(sum(case when o % 32 = 0 then col0 else v end) over (partition by img, b, o // 32 order by o) % 256 as bigint) as v from c""")
def col_row_sum_nozigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15."""
    flat = tiles.cells_of(tiles.tiles(tiles.grid(relations.px_events(spark, sf_dir))), tiles.BIG)
    return scans.column_row_sum(flat, zigzag=False).withColumn("v", F.col("v").cast("long"))


@query("""with n as (select unnest(range(24 * 15)) as id), k as (select id, id % 24 as x, id // 24 as y from n)
select row_number() over (order by y // 4, x // 4, y, x) - 1 as iter, id as blocki from k""")
def blocki_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane of 190 x 120 cells has 24 x 15 blocks; edge groups are not full."""
    return tiles.visit_order(190, 120, 8, 4, spark)


@query(f"with {SMALL} select img, b as by, s, so // 32 as half, string_agg(cast(v as varchar), ',' order by so) as syms from sb group by all")
def half_block_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H11, H18."""
    rows = tiles.halves(_events_tiles(spark, sf_dir))
    return rows.select("img", "by", F.col("s").cast("long").alias("s"), F.col("half").cast("long").alias("half"), text("syms").alias("syms"))


@query(f"with {DENSE} select img, b as by, string_agg(cast(v as varchar), ',' order by o) as cells from g group by all")
def half_block_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves to blocks, blocks to tiles."""
    rows = tiles.halves(_events_tiles(spark, sf_dir))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("s", "half", "syms"))), lambda x: x["syms"])
    whole = rows.groupBy("img", "by", "bx").agg(blocks.alias("h"))  # 32 halves
    joined = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda s: F.concat(F.get("h", s * 2), F.get("h", s * 2 + 1)))
    back = whole.withColumn("blocks", joined).withColumn("d", tiles.join_small("blocks"))
    return back.select("img", "by", text(tiles.undelta_block("d", tiles.BIG)).alias("cells"))


# ---- k, costs and offsets

@query(f"with {BESTK} select img, b as by, s, k from bk")
def optimal_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01, F03, F04."""
    return _best(_events_tiles(spark, sf_dir)).select("img", "by", F.col("s").cast("long").alias("s"), F.col("k").cast("long").alias("k"))


@query(f"with {BESTK} select k, count(*) as blocks, count(distinct img) as imgs from bk group by 1")
def k_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how often each k is best."""
    best = _best(_events_tiles(spark, sf_dir))
    return best.groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("blocks"), F.countDistinct("img").alias("imgs"))


@query(f"""with {BESTK}, m as (select img, b * 16 + s as blocki, k from bk union all select img, max(b * 16 + s) + 1, 0 from bk group by 1)
select img, blocki // 65536 as part, string_agg(lpad(hex(k), 2, '0'), '' order by blocki) as ks from m group by all""")
def k_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k tables as stored, in parts, a zero byte last."""
    best = _best(_events_tiles(spark, sf_dir)).withColumn("blocki", F.col("by") * 16 + F.col("s"))
    return rice.k_table(best).select("img", "part", F.hex("ks").alias("ks"))


@query(f"""with {BESTK}, m as (select *, b * 16 + s as blocki from bk), t as (select img, max(blocki) as last from m group by 1)
select img, last - blocki as place, k from m join t using (img)""")
def k_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k table joined with a permutation, here the reverse order."""
    best = _best(_events_tiles(spark, sf_dir)).select("img", (F.col("by") * 16 + F.col("s")).alias("blocki"), F.col("k").cast("long").alias("k"))
    last = best.groupBy("img").agg(F.max("blocki").alias("last"))
    order = best.join(last, "img").select("img", "blocki", (F.col("last") - F.col("blocki")).alias("place"))
    return best.join(order, ["img", "blocki"]).select("img", "place", "k")


@query(f"""with {BESTK}, h as (select img, b, s, so // 32 as half, sum({COST}) as bits from sb join bk using (img, b, s) group by all)
select img, b as by, s, half, cast(bits as bigint) as bits, cast(coalesce(sum(bits) over (partition by img order by b, s, half rows between unbounded preceding and 1 preceding), 0) as bigint) as bit_offset from h""")
def half_block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E02, G17, G18."""
    rows = tiles.halves(_best(_events_tiles(spark, sf_dir)))
    sized = rows.select("img", "by", F.col("s").cast("long").alias("s"), F.col("half").cast("long").alias("half"), rice.cost("syms", "k").cast("long").alias("bits"))
    return rice.offsets_of(sized, "bits", ["by", "s", "half"])


@query(f"with {BESTK} select img, b * 16 + s as blocki, k, cast(coalesce(sum(k * 64) over (partition by img order by b, s rows between unbounded preceding and 1 preceding), 0) as bigint) as suffix_start from bk")
def suffix_block_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G19."""
    best = _best(_events_tiles(spark, sf_dir)).select("img", (F.col("by") * 16 + F.col("s")).alias("blocki"), F.col("k").cast("long").alias("k"))
    return rice.suffix_starts(best)


@query(f"with {CODED} select img, k, cast(count(*) filter (esc) as bigint) as escapes, cast(sum({COST}) as bigint) as bits, cast(sum((v >> k) + 1 + k) as bigint) as plain from cd group by all")
def escape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F02, F06."""
    return _coded(spark, sf_dir).select("img", F.col("k").cast("long").alias("k"), rice.escapes("syms", "k").cast("long").alias("escapes"),
                                        rice.cost("syms", "k").cast("long").alias("bits"), rice.plain_cost("syms", "k").cast("long").alias("plain"))


# ---- codes

@query(f"""with {BYTES} select v, k, case when (v >> k) >= 16 then repeat('0', 16) || lpad(bin(v), 8, '0') else repeat('0', cast(v >> k as int)) || '1' || case when k > 0 then right(lpad(bin(v), 8, '0'), cast(k as int)) else '' end end as code
from bv cross join (select unnest(range(8)) as k)""")
def symbol_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each byte's code under each k."""
    v = relations.px_events(spark, sf_dir).select(F.col("v").cast("long").alias("v")).distinct()
    rows = v.select("v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return rows.select("v", F.col("k").cast("long").alias("k"), rice.symbol_bits(F.col("v"), F.col("k")).alias("code"))


@query(f"with {CODED}, gr as (select img, k, o // 4 as g, string_agg(p, '' order by o) || string_agg(q, '' order by o) as part from cd group by all) select img, k, string_agg(part, '' order by g) as bits from gr group by all")
def rice_g4_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J05, J47."""
    return _coded(spark, sf_dir).select("img", F.col("k").cast("long").alias("k"), rice.grouped_bits("syms", "k").alias("bits"))


@query(f"with {CODED} select img, k, string_agg(case when esc then repeat('0', 16) || lpad(bin(v), 8, '0') else p || q end, '' order by o) as bits from cd group by all")
def rice_split16_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J03, J40."""
    return _coded(spark, sf_dir).select("img", F.col("k").cast("long").alias("k"), rice.interleaved_bits("syms", "k").alias("bits"))


@query(f"with {CODED} select img, k, string_agg(repeat('1', cast(v >> k as int)) || '0' || q, '' order by o) as bits from cd group by all")
def rice_plain_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code without escapes."""
    return _coded(spark, sf_dir).select("img", F.col("k").cast("long").alias("k"), rice.plain_bits("syms", "k").alias("bits"))


@query(f"""with {CODED} select img, k, string_agg(case when esc then repeat('0', 16) else p end, '' order by o) as first, string_agg(case when esc then lpad(bin(v), 8, '0') else q end, '' order by o) as second,
  string_agg(cast(least((v >> k) + 1, 17) as varchar), ',' order by o) as counts, string_agg(cast(case when esc then v else v - ((v >> k) << k) end as varchar), ',' order by o) as rests from cd group by all""")
def rice_split_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams, and their values as numbers."""
    return _coded(spark, sf_dir).select("img", F.col("k").cast("long").alias("k"), rice.split_prefix_bits("syms", "k").alias("first"), rice.split_suffix_bits("syms", "k").alias("second"),
                                        text(rice.prefix_counts("syms", "k")).alias("counts"), text(rice.remainders("syms", "k")).alias("rests"))


@query("""with b as (select unnest(range(64)) as key), a as (select key, lpad(bin(key), 6, '0') as s from b),
p as (select key, string_split(s, '1') as z, length(s) - length(replace(s, '1', '')) as n from a)
select key, cast(list_sum(list_transform(range(1, 1 + least(4, n)), lambda j: (length(z[j]) + 1) << (4 * (j - 1)))) as bigint) as packed from p where n > 0 union all select 0, 0""")
def prefix_lut6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J21."""
    return rice.lookup_table(spark).select(F.col("key").cast("long"), F.col("packed").cast("long"))


SYMS = f"with {EMBED} select img, string_agg(cast(v as varchar), ',' order by o) as syms from sy group by all"


@query(SYMS)
def rice_g4_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J06, J22 to J26, J29, J30, K01."""
    bits_ = _coded(spark, sf_dir).select("img", "k", rice.grouped_bits("syms", "k").alias("bits"))
    return decode.decode_grouped(bits_, 64).select("img", text("syms").alias("syms"))


@query(SYMS)
def rice_split16_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J04, J41."""
    bits_ = _coded(spark, sf_dir).select("img", "k", rice.interleaved_bits("syms", "k").alias("bits"))
    return decode.decode_interleaved(bits_, 64).select("img", text("syms").alias("syms"))


@query(SYMS)
def rice_plain_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J02."""
    bits_ = _coded(spark, sf_dir).select("img", "k", rice.plain_bits("syms", "k").alias("bits"))
    return decode.decode_plain(bits_, 64).select("img", text("syms").alias("syms"))


@query(SYMS)
def rice_split_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J08."""
    bits_ = _coded(spark, sf_dir).select("img", "k", rice.split_prefix_bits("syms", "k").alias("first"), rice.split_suffix_bits("syms", "k").alias("second"))
    return decode.decode_split(bits_, 64).select("img", text("syms").alias("syms"))


@query(f"with {CODED} select img, string_agg(cast(least((v >> k) + 1, 17) as varchar), ',' order by o) as counts from cd group by all")
def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix lengths read from bits."""
    bits_ = _coded(spark, sf_dir).select("img", rice.split_prefix_bits("syms", "k").alias("bits"))
    return decode.decode_prefixes(bits_, 64).select("img", text("counts").alias("counts"))


#: Cells of a band of a user's plane, which is one row of compact images: 32 rows of big blocks.
BAND = 32 * 1024
BANDS = f"""bp as (select img, i // {BAND} as band, i % {BAND} as i, v from px),
h as (select img, band, (max(i) // 32 + 1) * 32 as cells from bp group by 1, 2), f as (select img, band, unnest(range(cells)) as i from h),
fp as (select f.img, f.band, f.i, coalesce(v, 0) as v from f left join bp using (img, band, i))"""


@query(f"with {PX}, {BANDS} select img, band, string_agg(lpad(hex(v), 2, '0'), '' order by i) as data from fp group by 1, 2")
def rice_decode_undelta_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images encoded to stored words and decoded from their offsets."""
    return _by_band(codec.decode(codec.encode(_event_images(spark, sf_dir))), F.hex("data").alias("data"))


def _event_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' planes cut into bands of at most BAND cells; img is user and band in one number."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    band = F.floor(F.col("i") / BAND)
    rows = relations.px_events(spark, sf_dir).groupBy((F.shiftleft("img", 24) + band).alias("img")).agg(serial.to_bytes(listed).alias("data"))
    return codec.images(rows)


def _by_band(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(F.shiftright("img", 24).alias("img"), F.col("img").bitwiseAND((1 << 24) - 1).alias("band"), *columns)


HALVES = f"""h as (select img, b // 32 as band, b % 32 as b, s, so // 32 as half, k, sum({COST}) as bits from sb join bk using (img, b, s) group by all),
o as (select *, coalesce(sum(bits) over (partition by img, band order by b, s, half rows between unbounded preceding and 1 preceding), 0) as start from h)"""


@query(f"""with {BESTK}, {HALVES}
select img, band, cast(sum(bits) as bigint) as n_bits, string_agg(cast(start as varchar), ',' order by b, s, half) as offsets from o group by 1, 2""")
def codec_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact encoder's offsets are those of the relational plan."""
    return _by_band(codec.encode(_event_images(spark, sf_dir)), "n_bits", text("offsets").alias("offsets"))


@query(f"""with {BESTK},
cd as (select img, b // 32 as band, b % 32 as b, s, so, case when (v >> k) >= 16 then repeat('0', 16) || left(lpad(bin(v), 8, '0'), cast(8 - k as int)) else repeat('0', cast(v >> k as int)) || '1' end as p,
  case when k > 0 then right(lpad(bin(v), 8, '0'), cast(k as int)) else '' end as q from sb join bk using (img, b, s)),
gr as (select img, band, b, s, so // 4 as g, string_agg(p, '' order by so) || string_agg(q, '' order by so) as part from cd group by all),
st as (select img, band, string_agg(part, '' order by b, s, g) as bits from gr group by 1, 2),
n as (select *, ((length(bits) + 7) // 8 + 4 + 3) // 4 + 1 as words from st),
w as (select img, band, u, rpad(substr(bits, cast(32 * u + 1 as int), 32), 32, '0') as word from (select img, band, bits, unnest(range(words)) as u from n)),
y as (select img, band, u, j, lpad(to_base(cast(list_sum(list_transform(range(8), lambda t: cast(substr(word, cast(8 * j + t + 1 as int), 1) as bigint) << (7 - t))) as bigint), 16), 2, '0') as h
  from (select img, band, u, word, unnest(range(4)) as j from w))
select img, band, upper(string_agg(h, '' order by u, 3 - j)) as words from y group by 1, 2""")
def codec_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored words of the whole codec."""
    return _by_band(codec.encode(_event_images(spark, sf_dir)), F.hex("words").alias("words"))


@query(f"""with {BESTK}, h as (select img, b, s, so // 32 as half, sum({COST}) as bits from sb join bk using (img, b, s) group by all),
o as (select *, coalesce(sum(bits) over (partition by img order by b, s, half rows between unbounded preceding and 1 preceding), 0) as start from h)
select px.img, i // 32 as y, i % 32 as x, b * 16 + s as blocki, cast(start as bigint) as bit_offset
from px join o on o.img = px.img and o.b = i // 1024 and o.s = ((i // 32) % 32 // 8) * 4 + (i % 32) // 8 and o.half = (i // 32) % 8 // 4""")
def pixel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pixel the block that it is decoded in, and where that half block's bits begin."""
    sized = tiles.halves(_best(_events_tiles(spark, sf_dir))).select("img", "by", "s", "half", rice.cost("syms", "k").cast("long").alias("bits"))
    offsets = rice.offsets_of(sized, "bits", ["by", "s", "half"]).select("img", "by", "s", "half", "bit_offset")
    plane = tiles.grid(relations.px_events(spark, sf_dir))
    s = F.floor(F.col("y") % 32 / 8) * 4 + F.floor(F.col("x") / 8)
    keyed = plane.select("img", "y", "x", F.floor(F.col("y") / 32).alias("by"), s.cast("int").alias("s"), F.floor(F.col("y") % 8 / 4).cast("int").alias("half"))
    met = keyed.join(offsets, ["img", "by", "s", "half"])
    return met.select("img", "y", "x", (F.col("by") * 16 + F.col("s")).cast("long").alias("blocki"), "bit_offset")


@query(f"""with {PX}, m as (select img, max(i // 32) as rows from px group by 1)
select img, i // 32 as y, i % 32 as x, v from px join m using (img) where i // 32 < rows and i % 32 < 30""")
def unpack_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cells in a word, taken apart and cropped."""
    plane = tiles.grid(relations.px_events(spark, sf_dir))
    byte = F.call_function("shiftleft", F.col("v").cast("long"), ((F.col("x") % 4) * 8).cast("int"))
    words = plane.withColumn("b", byte).groupBy("img", "y", F.floor(F.col("x") / 4).alias("x")).agg(F.sum("b").alias("word"))
    rows = plane.groupBy("img").agg(F.max("y").alias("rows"))
    return tiles.unpacked(words.join(rows, "img"), 30, F.col("rows")).withColumn("v", F.col("v").cast("long"))


@query("select doc_id as img, hex(encode(coalesce(text, ''))) || repeat('00', cast((32 - strlen(coalesce(text, '')) % 32) % 32 as int)) as data from documents where strlen(coalesce(text, '')) > 0")
def document_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every document that has some as an image, encoded and decoded."""
    rows = codec.images(relations.px_docs(spark, sf_dir))
    return codec.decode(codec.encode(rows)).select("img", F.hex("data").alias("data"))


# ---- checks

@query(f"""with {PX}, b as (select * from px), n as (select img, count(*) as n, sum(v) % 65521 as s1 from b group by 1), t as (select b.img, n, s1, sum((n - i) * v) % 65521 as s2 from b join n using (img) group by all)
select img, cast(case when s2 * 65536 + s1 = 0 then 4294967295 else s2 * 65536 + s1 end as bigint) as adler from t""")
def adler32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F07."""
    return checks.adler32(relations.px_events(spark, sf_dir))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return relations.px_events(spark, sf_dir).select("img", "i", v.alias("b"), F.when(F.col("img") % 3 == 0, v).otherwise(v * 3 % 256).alias("g"), v.alias("r"),
                                                     F.when((F.col("img") % 5 == 0) & (F.col("i") == 3), 254).otherwise(255).alias("a"))


PIXELS = PX + ", q as (select img, i, v as b, case when img % 3 = 0 then v else v * 3 % 256 end as g, v as r, case when img % 5 = 0 and i = 3 then 254 else 255 end as a from px)"


@query(f"with {PIXELS} select img, case when max(case when a <> 255 then 1 else 0 end) = 1 then 4 when max(case when r <> g or g <> b then 1 else 0 end) = 1 then 3 else 1 end as n from q group by 1")
def component_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F09, D07, A12."""
    return checks.components(_pixels(spark, sf_dir))


@query(f"with {PIXELS} select img, i, channel, v from q unpivot (v for channel in (b, g, r, a))")
def split_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C29."""
    q = _pixels(spark, sf_dir).select("img", "i", *[F.col(c).cast("long").alias(c) for c in "bgra"])
    return q.unpivot(["img", "i"], ["b", "g", "r", "a"], "channel", "v")


@query(f"""with {PIXELS}, u as (select img, i, channel, v from q unpivot (v for channel in (b, g, r, a))), n as (select img, channel, count(*) as n, sum(v) % 65521 as s1 from u group by all),
t as (select u.img, u.channel, s1, sum((n - i) * v) % 65521 as s2 from u join n on n.img = u.img and n.channel = u.channel group by all)
select img, channel, cast(case when s2 * 65536 + s1 = 0 then 4294967295 else s2 * 65536 + s1 end as bigint) as adler, true as agrees from t""")
def channel_adler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """checksums by channel, and again over what is decoded."""
    q = split_components(spark, sf_dir)
    keyed = q.select(F.struct("img", "channel").alias("img"), "i", "v")
    again = scans.undelta(scans.delta(q.select(F.concat_ws(":", "img", "channel").alias("img"), "i", "v")))
    second = checks.adler32(again).select(F.col("img").alias("key"), F.col("adler").alias("second"))
    first = checks.adler32(keyed).select(F.col("img.img").alias("img"), F.col("img.channel").alias("channel"), "adler")
    met = first.join(second, F.concat_ws(":", "img", "channel") == F.col("key"))
    return met.select("img", "channel", "adler", (F.col("adler") == F.col("second")).alias("agrees"))


@query(f"with {PX} select img, i, v as left_v, (v + 1) % 256 as right_v from px where v % 64 = 0")
def compare_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a plane differs from one that is changed at every multiple of 64."""
    px = relations.px_events(spark, sf_dir).withColumn("v", F.col("v").cast("long"))
    changed = px.withColumn("v", F.when(F.col("v") % 64 == 0, (F.col("v") + 1) % 256).otherwise(F.col("v")))
    return checks.differences(px, changed, ["img", "i"])


# ---- serialization

@query(f"""with {PX} select img, i, lpad(hex(v), 2, '0') as u8, substr(h16, 3, 2) || substr(h16, 1, 2) as u16, substr(h32, 7, 2) || substr(h32, 5, 2) || substr(h32, 3, 2) || substr(h32, 1, 2) as u32, n as back from
(select img, i, v, v * 16909060 % 4294967296 as n, lpad(hex(v * 257), 4, '0') as h16, lpad(hex(v * 16909060 % 4294967296), 8, '0') as h32 from px)""")
def little_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C40, C41."""
    px = relations.px_events(spark, sf_dir).withColumn("n", F.col("v").cast("long") * 16909060 % 4294967296)
    four = serial.little("n", 4)
    return px.select("img", "i", F.hex(serial.little(F.col("v").cast("long"), 1)).alias("u8"), F.hex(serial.little(F.col("v").cast("long") * 257, 2)).alias("u16"), F.hex(four).alias("u32"),
                     serial.read_little(four, F.lit(0), 4).alias("back"))


ROWS = EMBED + ", rw as (select img, list(v order by o) as a from sy group by 1)"
HEX = "array_to_string(list_transform({0}, lambda v: lpad(hex(v), 2, '0')), '')"


@query(f"""with {ROWS}, n as (select img, a, list_transform(a, lambda v: v % 16) as nb from rw),
p as (select *, list_transform(range(1, 33), lambda j: nb[2 * j - 1] + 16 * nb[2 * j]) as m from n)
select img, '20000000' || {HEX.format('m')} as packed, array_to_string(nb, ',') as back from p""")
def nibble_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C44 to C46."""
    rows = relations.px_embed(spark, sf_dir).select("img", F.transform("syms", lambda v: v % 16).alias("n"))
    packed = serial.counted_nibbles("n")
    return rows.select("img", packed.alias("p")).select("img", F.hex("p").alias("packed"), text(serial.read_counted_nibbles("p")).alias("back"))


@query(f"""with {ROWS}, n as (select img, list_transform(a[1:61], lambda v: v % 2) as b from rw),
p as (select *, list_transform(range(8), lambda j: list_sum(list_transform(range(8), lambda t: coalesce(b[8 * j + t + 1], 0) << t))) as m from n)
select img, '3D000000' || {HEX.format('m')} as packed, array_to_string(b, ',') as back from p""")
def bit_pack_lsb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """61 bits of each row."""
    rows = relations.px_embed(spark, sf_dir).select("img", F.transform(F.slice("syms", 1, 61), lambda v: v % 2).alias("b"))
    return rows.select("img", serial.counted_bits("b").alias("p")).select("img", F.hex("p").alias("packed"), text(serial.read_counted_bits("p")).alias("back"))


@query(f"""with {ROWS}, n as (select img, list_transform(a, lambda v: v * 251) as w from rw)
select img, {HEX.format('list_transform(w, lambda x: x % 256)')} || {HEX.format('list_transform(w, lambda x: x >> 8)')} as planes, array_to_string(w, ',') as back from n""")
def planar16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C48."""
    rows = relations.px_embed(spark, sf_dir).select("img", F.transform("syms", lambda v: v * 251).alias("w"))
    packed = rows.select("img", serial.planar16("w").alias("p"), serial.planar16("w", True).alias("c"))
    same = F.when(serial.read_planar16("p") == serial.read_planar16("c", True), text(serial.read_planar16("p")))
    return packed.select("img", F.hex("p").alias("planes"), same.alias("back"))


@query(f"""with {ROWS} select img, '40000000' || {HEX.format('a')} as counted, array_to_string(a, ',') as back, array_to_string(list_transform(range(64), lambda p: a[(p % 16) * 4 + p // 16 + 1]), ',') as dealt,
  array_to_string(a[1:24], ',') || ';' || array_to_string(a[25:48], ',') || ';' || array_to_string(a[49:64], ',') as runs, array_to_string(a[17:32], ',') as second, array_to_string(a, ' ') as shown from rw""")
def array_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C42, C43, C49 to C54, H13."""
    rows = relations.px_embed(spark, sf_dir).withColumn("c", serial.counted("syms"))
    runs = serial.split_runs("syms", 24)
    return rows.select("img", F.hex("c").alias("counted"), text(serial.read_counted("c")).alias("back"), text(serial.deinterleave("syms", 4)).alias("dealt"),
                       F.array_join(F.transform(runs, lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")), ";").alias("runs"),
                       text(F.get(serial.split_streams("syms", 4), F.lit(1))).alias("second"), serial.numbers_text(F.flatten(runs)).alias("shown"))


@query(f"""with {ROWS} select img, {HEX.format('list_transform(range(64), lambda i: a[(i // 4) * 4 + 4 - i % 4])')} as words32, {HEX.format('list_transform(range(64), lambda i: a[(i // 8) * 8 + 8 - i % 8])')} as words64 from rw""")
def word_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H14, H15, H16."""
    rows = relations.px_embed(spark, sf_dir).select("img", serial.to_bytes("syms").alias("d"))
    return rows.select("img", F.hex(serial.swap_words("d")).alias("words32"), F.hex(serial.swap_words("d", 8)).alias("words64"))


@query(f"""with {CODED}, gr as (select img, o // 4 as g, string_agg(p, '' order by o) || string_agg(q, '' order by o) as part from cd group by all), b as (select img, string_agg(part, '' order by g) as bits from gr group by 1),
n as (select img, bits, (length(bits) + 7) // 8 as n from b), f as (select img, rpad(bits, cast(((n + 4 + 3) // 4 * 4 + 4) * 8 as int), '0') as bits, (n + 4 + 3) // 4 * 4 + 4 as total from n)
select img, array_to_string(list_transform(range(total), lambda i: lpad(to_base(cast(list_sum(list_transform(range(8), lambda t: cast(bits[8 * ((i // 4) * 4 + 3 - i % 4) + t + 1] as bigint) << (7 - t))) as bigint), 16), 2, '0')), '') as words from f""")
def stored_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of blocks as stored words."""
    bits_ = _coded(spark, sf_dir).select("img", rice.grouped_bits("syms", "k").alias("bits"))
    return bits_.select("img", F.hex(serial.frame_words("bits")).alias("words"))


@query(f"with {ROWS} select img, (a[1] % 8) * 512 + a[2] * 2 + (a[3] >> 7) as bits from rw")
def bit_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 bits of each row after the first 5."""
    rows = relations.px_embed(spark, sf_dir).select("img", serial.to_bytes("syms").alias("data"))
    return decode.read_bits(rows, 5, 12).select("img", "bits")


# ---- several streams

STREAMS = f"with {EMBED} select img // 4 as img, img % 4 as stream, string_agg(cast(v as varchar), ',' order by o) as syms from sy group by all"


def _muxed(spark: SparkSession, sf_dir: str, unit: int) -> DataFrame:
    """Four vectors at a time as streams in one."""
    rows = _coded(spark, sf_dir).select(
        F.floor(F.col("img") / 4).cast("long").alias("img"), (F.col("img") % 4).cast("int").alias("stream"), F.array("k").alias("ks"), rice.interleaved_bits("syms", "k").alias("bits")
    )
    packed = serial.swap_words(serial.frame_words("bits"))  # bytes in order
    return mux.multiplexed(rows.select("img", "stream", "ks", packed.alias("data")), 64, 64, unit)


def _apart(muxed: DataFrame, unit: int) -> DataFrame:
    return mux.demultiplexed(muxed, 64, 64, unit).select("img", F.col("stream").cast("long").alias("stream"), text("syms").alias("syms"))


@query(STREAMS)
def mux_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams in one, and apart again."""
    return _apart(_muxed(spark, sf_dir, 1), 1)


@query(STREAMS)
def mux64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with words of eight bytes."""
    return _apart(_muxed(spark, sf_dir, 8), 8)


# a decoder that has used c bits has read all units up to the one with bit c + 24, the first time that it asks there
MUXED = f"""with {{coded}},
wd as (select img // 4 as g, img % 4 as st, img, o, case when esc then 16 else (v >> k) + 1 end as a, case when esc then 8 else k end as z,
  case when esc then repeat('0', 16) || lpad(bin(v), 8, '0') else p || q end as code from cd),
ev as (select g, st, img, o, code, sum(a + z) over w - a - z as c0, sum(a + z) over w - z as c1 from wd window w as (partition by img order by o)),
st as (select img, string_agg(code, '' order by o) || repeat('0', 320) as bits from ev group by 1),
rd as (select g, st, img, o, e, (c + 24) // {{n}} + 1 as r from (select g, st, img, o, unnest([0, 1]) as e, unnest([c0, c1]) as c from ev)),
nw as (select *, coalesce(lag(r) over (partition by img order by o, e), 0) as before from rd),
un as (select g, o, st, e, img, unnest(range(cast(before as bigint), cast(r as bigint))) as u from nw),
hx as (select g, o, st, e, u, array_to_string(list_transform(range({{n}} // 8), lambda j: lpad(to_base(cast(list_sum(list_transform(range(8), lambda t: cast(substr(bits, cast(u * {{n}} + 8 * j + t + 1 as int), 1) as bigint) << (7 - t))) as bigint), 16), 2, '0')), '') as h
  from un join st using (img))
select g as img, upper(string_agg(h, '' order by o, st, e, u)) as mux from hx group by 1"""


@query(MUXED.format(coded=CODED, n=8))
def mux_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the stream in which four are multiplexed."""
    return _muxed(spark, sf_dir, 1).select("img", F.hex("mux").alias("mux"))


@query(MUXED.format(coded=CODED, n=64))
def mux64_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by words of eight bytes, the first bit highest."""
    return _muxed(spark, sf_dir, 8).select("img", F.hex("mux").alias("mux"))


@query(f"""with {PX}, r as (select img, i, 1 + v % 3 as count, 16 * (1 + v % 4) as n from px),
s as (select *, coalesce(sum(count) over (partition by img order by i rows between unbounded preceding and 1 preceding), 0) as first from r)
select img, cast(first + j as bigint) as blocki, n from (select img, first, n, unnest(range(count)) as j from s)""")
def expand_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of counts and sizes as one row for each block."""
    v = F.col("v").cast("long")
    runs = relations.px_events(spark, sf_dir).select("img", F.col("i").alias("run"), (v % 3 + 1).alias("count"), ((v % 4 + 1) * 16).alias("n"))
    return rice.expand_runs(runs)


# ---- files

@query("""with s as (select unnest(['8x8_ident', '16x8_ident', '16x16_ident', '16x16_delta_ident', '32x32_delta_ident']) as config, unnest([8, 16, 16, 16, 32]) as w, unnest([8, 8, 16, 16, 32]) as h),
c as (select config, w, unnest(range(w * h)) as i from s)
select config, i // w as y, i % w as x, case when config like '%delta%' then (i * (i + 1) // 2) % 256 else i % 256 end as v from c""")
def generated_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named test planes."""
    out = None
    for config in ("8x8_ident", "16x8_ident", "16x16_ident", "16x16_delta_ident", "32x32_delta_ident"):
        one = generators.frame(spark, config).select(F.lit(config).alias("config"), "y", "x", F.col("v").cast("long").alias("v"))
        out = one if out is None else out.union(one)
    return out


@query(f"with {BESTK}, {HALVES} select img, band, b * 16 + s as blocki, k, half, cast(start as bigint) as bit_offset from o")
def codec_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored tables of k and offsets joined by block."""
    k, offsets, _ = codec.relations(codec.encode(_event_images(spark, sf_dir)))
    halves = offsets.select("img", F.floor(F.col("half") / 2).cast("int").alias("blocki"), (F.col("half") % 2).cast("long").alias("half"), "bit_offset")
    met = halves.join(k, ["img", "blocki"])
    return _by_band(met, F.col("blocki").cast("long").alias("blocki"), F.col("k").cast("long").alias("k"), "half", "bit_offset")


KINDS = ("png", "bmp", "tiff", "tga")


@query(f"""with {PX}, {BANDS}, d as (select img, band, count(*) // 32 as height, string_agg(repeat(lpad(hex(v), 2, '0'), 3) || case when v = 7 then 'FE' else 'FF' end, '' order by i) as bgra, max(case when v = 7 then 32 else 24 end) as bits from fp group by 1, 2)
select img, band, kind, 32 as width, height, bits, bgra from d cross join (select unnest({list(KINDS)}) as kind)""")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray planes as image files of each kind, and read again; some pixels aren't opaque."""
    pixel = serial.to_bytes(F.flatten(F.transform(serial.from_bytes("data"), lambda v: F.array(v, v, v, F.when(v == 7, 254).otherwise(255)))))
    rows = _event_images(spark, sf_dir).select("img", "width", "height", pixel.alias("bgra"))
    out = None
    for kind in KINDS:
        files = images.encode_images(rows, kind).select("img", F.col("file").alias("content"))

        def some(frames):
            for f in frames:
                yield pd.DataFrame([(i, *images.decoded(c)[:4]) for i, c in zip(f["img"], f["content"])], columns=["img", "width", "height", "bgra", "bits"])

        back = files.mapInPandas(some, "img long, width int, height int, bgra binary, bits int")
        one = _by_band(back, F.lit(kind).alias("kind"), F.col("width").cast("long"), F.col("height").cast("long"), F.col("bits").cast("long"), F.hex("bgra").alias("bgra"))
        out = one if out is None else out.union(one)
    return out


GRIDS = {name: values for name, values in generators.LITERALS.items() if name.startswith("grid")}


@query("with g(config, w, cells) as (values " + ", ".join(f"('{name}', {width}, {cells})" for name, (width, cells) in GRIDS.items()) + """),
c as (select config, w, cells, unnest(range(len(cells))) as i from g) select config, i // w as y, i % w as x, cast(cells[i + 1] as bigint) as v from c""")
def literal_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small planes given cell by cell."""
    out = None
    for name in GRIDS:
        one = generators.frame(spark, name).select(F.lit(name).alias("config"), "y", "x", F.col("v").cast("long").alias("v"))
        out = one if out is None else out.union(one)
    return out


@query("""with s as (select unnest(['8x8_ident_2048', '8x8_ident_4096']) as config, unnest([2048, 4096]) as w, unnest([1536, 4096]) as h),
c as (select config, w, unnest(range(w * h)) as i from s)
select config, i // w as y, count(*) as n, cast(sum(i % 256) as bigint) as total, cast(sum(i % 256 * (i % w + 1)) as bigint) as weighted from c group by 1, 2""")
def large_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest named planes, by row."""
    out = None
    for config in ("8x8_ident_2048", "8x8_ident_4096"):
        v, x = F.col("v").cast("long"), F.col("x") + 1
        one = generators.frame(spark, config).groupBy(F.lit(config).alias("config"), "y").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * x).alias("weighted"))
        out = one if out is None else out.union(one)
    return out
