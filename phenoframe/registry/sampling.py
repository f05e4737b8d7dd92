"""Splits, samples, draws and augmentation; every choice is a hash of seed and key."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.operators import sampling
from phenoframe.operators.augment import drop_steps_and_jitter, mask_steps_and_jitter
from phenoframe.operators.composite import decadal_composite
from phenoframe.operators.filters import clear_scenes
from phenoframe.registry.base import query, r, rounded, sr
from phenoframe.registry.roles import (
    BANDS, COMP, OBS, PIXEL, PTS, TENSOR, TENSOR_STEPS, observations, pixels, points, table, tensor_rows, tensors, with_ctes,
)
from phenoframe.scale.ranks import hash_rank, sequential_id

RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42-' || id), id) AS rank,
  count(*) OVER (PARTITION BY y) AS n FROM pts)"""


@query("class_rank", with_ctes(PTS, RANKED, body="SELECT id, y, rank FROM ranked"))
def class_rank(spark, sf):
    return hash_rank(points(spark, sf).select("id", "y"), ["y"], ["id"])


@query("paper_split", with_ctes(PTS, RANKED, body="""
SELECT id, y, CASE WHEN rank <= 240 THEN 'train' WHEN rank <= 300 THEN 'val' ELSE 'test' END AS split FROM ranked"""))
def paper(spark, sf):
    return sampling.paper_split(points(spark, sf).select("id", "y"), "y", ["id"])


@query("ratio_split", with_ctes(PTS, RANKED, body="""
SELECT id, y, CASE WHEN rank <= floor(n * CAST(0.15 AS DOUBLE) + 0.5) THEN 'test'
  WHEN rank <= floor(n * CAST(0.3 AS DOUBLE) + 0.5) THEN 'val' ELSE 'train' END AS split FROM ranked"""))
def ratio(spark, sf):
    return sampling.ratio_split(points(spark, sf).select("id", "y"), ["y"], ["id"])


@query("zone_split", with_ctes(PTS, body="""
SELECT id, y, zone, CASE WHEN row_number() OVER (PARTITION BY y, zone ORDER BY md5('42-' || id), id)
  <= floor(count(*) OVER (PARTITION BY y, zone) * CAST(0.2 AS DOUBLE) + 0.5) THEN 'val' ELSE 'train' END AS split FROM pts"""))
def zone(spark, sf):
    return sampling.zone_split(points(spark, sf).select("id", "y", "zone"), "y", "zone", ["id"])


@query("quota_sample", with_ctes(PTS, RANKED, body="""
SELECT id, y FROM ranked WHERE rank <= CASE y WHEN 0 THEN 2054 WHEN 1 THEN 974 WHEN 2 THEN 783 WHEN 3 THEN 640 ELSE 0 END"""))
def quota(spark, sf):
    quotas = {0: 2054, 1: 974, 2: 783, 3: 640}
    return sampling.quota_sample(points(spark, sf).select("id", "y"), "y", ["id"], quotas)


@query("equal_sample", with_ctes(PTS, RANKED, body="SELECT id, y FROM ranked WHERE rank <= 2000 // 5"))
def equal(spark, sf):
    return sampling.equal_sample(points(spark, sf).select("id", "y"), "y", ["id"], 2000)


@query("uniform_sample", with_ctes(PTS, body="SELECT id, y FROM pts ORDER BY md5('42-' || id), id LIMIT 1234"))
def uniform(spark, sf):
    return sampling.uniform_sample(points(spark, sf).select("id", "y"), ["id"], 1234)


SLOTS = """counts AS (SELECT y, count(*) AS n FROM pts GROUP BY y),
slots AS (SELECT y, n, unnest(range({take})) AS slot FROM counts),
picks AS (SELECT y, slot, CAST('0x' || substr(md5('42-' || y || '-' || slot), 1, 15) AS BIGINT) % n + 1 AS rank FROM slots),
drawn AS (SELECT r.id, r.y, p.slot FROM picks p JOIN ranked r ON r.y = p.y AND r.rank = p.rank)"""


@query("replacement_sample", with_ctes(PTS, RANKED, SLOTS.format(take="least(500, n)"), body="""
SELECT id, y, slot FROM drawn ORDER BY md5('42-' || y || '-' || slot), y, slot LIMIT 2000"""))
def replacement(spark, sf):
    rows = points(spark, sf).select("id", "y")
    return sampling.replacement_sample(rows, "y", ["id"], min_per_class=500, max_samples=2000)


@query("oversample_balanced", with_ctes(PTS, RANKED, SLOTS.format(take="(SELECT max(n) FROM counts)"), body="""
SELECT id, y, slot FROM drawn"""))
def oversample(spark, sf):
    return sampling.oversample_balanced(points(spark, sf).select("id", "y"), "y", ["id"])


@query("two_phase_sampling", with_ctes(OBS, PIXEL, """picked AS (
  SELECT pixel_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42-' || pixel_id), pixel_id) AS rank FROM pixel) WHERE rank <= 8)""",
  COMP.replace("FROM obs WHERE", "FROM obs WHERE pixel_id IN (SELECT pixel_id FROM picked) AND"), body="""
SELECT pixel_id, year, bin, green, red, nir, swir, valid FROM comp"""))
def two_phase(spark, sf):
    picked = sampling.equal_sample(pixels(spark, sf).select("pixel_id", "y"), "y", ["pixel_id"], 40)
    wanted = sampling.read_sampled(clear_scenes(observations(spark, sf)), picked, ["pixel_id"])
    return decadal_composite(wanted, ["pixel_id"], "obs_date", BANDS)


@query("sequential_id", """
SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS id, o_orderkey FROM orders
""")
def sequential(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sequential_id(rows, ["o_totalprice", "o_orderkey"]).select("id", "o_orderkey")


@query("random_order", with_ctes(PTS, body="SELECT id, y FROM pts ORDER BY md5('42-' || id), id"))
def random_order(spark, sf):
    return sampling.hash_ordered(points(spark, sf).select("id", "y"), ["id"])


def _word(text: str, word: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {1 + 8 * word}, 8) AS BIGINT)"


def _noise(text: str) -> str:
    u, v = _word(text, 0), _word(text, 1)
    return f"sqrt(-2.0 * ln(({u} + 0.5) / CAST(4294967296 AS DOUBLE))) * cos(2.0 * pi() * ({v} / CAST(4294967296 AS DOUBLE)))"


def filled_tensors(spark, sf):
    full = F.transform("series", lambda s: F.forall(s, lambda x: x.isNotNull()))
    known = F.transform("series", lambda s: F.transform(s, lambda x: F.coalesce(x, F.lit(0.0))))
    return tensors(spark, sf).select("vec_id", full.alias("mask"), known.alias("series"))


FILLED = """filled AS (SELECT vec_id, t, c, COALESCE(x, 0) AS x, count(x) OVER (PARTITION BY vec_id, t) = 4 AS m FROM tensor)"""
TOTAL = "CAST(4294967296 AS DOUBLE)"


@query("augment_drop_steps", with_ctes(TENSOR, FILLED, f"""steps AS (
  SELECT vec_id, t, row_number() OVER (PARTITION BY vec_id ORDER BY md5('42-' || vec_id || '-' || t), t) AS place
  FROM (SELECT DISTINCT vec_id, t FROM filled)),
chosen AS (SELECT vec_id, {_word("'42-' || vec_id", 0)} / {TOTAL} <= 0.6 AS hit,
  greatest(1, round_even(16.0 * (CAST(0.1 AS DOUBLE) + {_word("'42-' || vec_id", 1)} / {TOTAL} * CAST(0.2 - 0.1 AS DOUBLE)), 0)) AS k
  FROM (SELECT DISTINCT vec_id FROM filled))""", body=f"""
SELECT f.vec_id, f.t, f.c, {sr(f'''CASE WHEN NOT hit THEN f.x ELSE CASE WHEN place <= k THEN 0 ELSE f.x END
  + CASE WHEN f.m THEN {_noise("'42n-' || f.vec_id || '-' || f.t || '-' || f.c")} * CAST(0.005 AS DOUBLE) ELSE 0 END END''', 'x', 7)}
FROM filled f JOIN steps s ON s.vec_id = f.vec_id AND s.t = f.t JOIN chosen h ON h.vec_id = f.vec_id"""))
def augment_drop(spark, sf):
    changed = drop_steps_and_jitter(filled_tensors(spark, sf), ["vec_id"], TENSOR_STEPS, p=0.6)
    return rounded(tensor_rows(changed, ["vec_id"]), ["x"], 7)


@query("augment_mask_steps", with_ctes(TENSOR, FILLED, body=f"""
SELECT vec_id, t, c, m AND keep AS valid, {sr(f'''CASE WHEN keep THEN x + CASE WHEN m THEN {_noise("'42n-' || vec_id || '-' || t || '-' || c")} * CAST(0.02 AS DOUBLE) ELSE 0 END ELSE 0 END''', 'x', 7)}
FROM (SELECT *, {_word("'42-' || vec_id || '-' || t", 0)} / {TOTAL} > 0.05 AS keep FROM filled)"""))
def augment_mask(spark, sf):
    changed = mask_steps_and_jitter(filled_tensors(spark, sf), ["vec_id"])
    steps = changed.select("vec_id", F.posexplode_outer(F.arrays_zip("series", "mask")).alias("t", "z"))
    rows = steps.select("vec_id", "t", F.col("z.mask").alias("valid"), F.posexplode_outer("z.series").alias("c", "x"))
    return rounded(rows, ["x"], 7)


@query("split_union", with_ctes(PTS, RANKED, body="""
SELECT y, CASE WHEN rank <= 240 THEN 'train' ELSE 'val' END AS split, count(*) AS n, sum(id)::BIGINT AS ids FROM ranked WHERE rank <= 300 GROUP BY ALL"""))
def split_union(spark, sf):
    split = sampling.paper_split(points(spark, sf).select("id", "y"), "y", ["id"])
    both = split.where("split = 'train'").unionByName(split.where("split = 'val'"))
    return both.groupBy("y", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
