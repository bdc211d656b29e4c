"""Queries over pictures that Spark makes of the embeddings: hashes, their near pairs, descriptors and stand-in embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curato.operators import duplicates, models, pictures
from curato.operators.graph import materialise
from curato.plans.assets import read

#: Side of a picture; bits in which near hashes differ at most.
SIDE, NEAR = 32, 8


def _draw(vectors: pa.Array, copies: pa.Array) -> pa.Array:
    """The bytes of 32 by 32 pixels of three channels for each vector; where it lacks a number, pixels are 255."""
    i = np.arange(3 * SIDE * SIDE)
    c, x, y = i % 3, i // 3 % SIDE, i // (3 * SIDE)
    a, b = y // 4, x // 4
    place = np.where(c == 0, a * 8 + b, np.where(c == 1, 63 - a * 8 - b, b * 8 + a))
    pattern = (x * (c + 2) + y * 3) % 32 - 16
    lists = vectors.to_pylist() if vectors.null_count or vectors.values.null_count else None
    out = []
    for n, copy in enumerate(copies.to_pylist()):
        held = np.full(64, np.nan)
        if lists is None:
            own, gaps = vectors[n].values.to_numpy()[:64].astype(float), np.ones(64, bool)
            gaps[: len(own)] = False
        else:
            found = (lists[n] or [])[:64]
            own, gaps = np.array([0.0 if v is None else v for v in found]), np.array([v is None for v in found] + [True] * (64 - len(found)))
        held[: len(own)] = own
        base = np.clip(np.nan_to_num(np.floor(127.5 + 400 * held), nan=0.0), -(1 << 40), 1 << 40)
        value = base[place] + pattern + copy * (x % 3) * 4
        out.append(np.where(gaps[place], 255, np.clip(value, 0, 255)).astype(np.uint8).tobytes())
    return pa.array(out, pa.binary())


_drawn = F.arrow_udf(_draw, T.BinaryType())


def embedding_pictures(spark, sf: str, copies: int = 1) -> DataFrame:
    """Each vector of 64 numbers as a picture of 32 by 32: cells of four by four pixels, with a pattern over them.

    Of several copies, which have ids of their own, the further ones are a little brighter in some columns. Vectors are
    dealt by their id first: their files are small, and pictures and what is made of them are not.
    """
    rows = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v")).repartition("vec_id")
    rows = rows.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    return rows.select((F.col("vec_id") * copies + F.col("copy")).alias("vec_id"), *(F.lit(n).alias(c) for c, n in (("width", SIDE), ("height", SIDE), ("channels", 3), ("orientation", 1))), _drawn("v", "copy").alias("data"))


def picture_hashes(spark, sf):
    return embedding_pictures(spark, sf).select("vec_id", pictures.perceptual_hash().alias("phash"))


def picture_hash_pairs(spark, sf):
    """Near hashes among the pictures and a copy of each."""
    hashes = embedding_pictures(spark, sf, 2).select("vec_id", pictures.perceptual_hash().alias("phash"))
    return duplicates.hamming_pairs(materialise(hashes, "hashes"), "vec_id", "phash", NEAR)


def picture_descriptors(spark, sf):
    rows = embedding_pictures(spark, sf).select("vec_id", F.posexplode(pictures.descriptor()).alias("place", "x"))
    return rows.select("vec_id", "place", F.round("x", 6).alias("x"))


def picture_embeddings(spark, sf):
    """Pictures of 8 by 8, which the stand-in embedding takes as they are, as one number each: the largest, and where it is."""
    rows = embedding_pictures(spark, sf).select("vec_id", F.posexplode(pictures.tiny_embedding()).alias("place", "x"))
    most = rows.groupBy("vec_id").agg(F.max(F.struct(F.round("x", 9).alias("x"), (-F.col("place")).alias("place"))).alias("m"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("length"))
    return most.select("vec_id", F.round("m.x", 6).alias("most"), (-F.col("m.place")).alias("place"), F.round(F.abs("total"), 6).alias("total"), F.round("length", 6).alias("length"))


def picture_tags(spark, sf):
    rows = models.tag_pictures(embedding_pictures(spark, sf), "vec_id", models.ColourTagger())
    # Scores are sums of 1024 bytes over their greatest: whole numbers have no ties to round.
    return rows.select("vec_id", "model_id", "place", "tag", F.round(F.col("score") * (255 * SIDE * SIDE)).cast("long").alias("level"), "model_category", "selected")


_PIXELS = f"""px AS (SELECT vec_id * {{n}} + copy AS vec_id, c, x, y, CAST(greatest(0, least(255, floor(127.5 + 400 * CAST(embedding[1 + CASE c WHEN 0 THEN (y // 4) * 8 + x // 4 WHEN 1 THEN 63 - (y // 4) * 8 - x // 4 ELSE (x // 4) * 8 + y // 4 END] AS DOUBLE)) + (x * (c + 2) + y * 3) % 32 - 16 + copy * (x % 3) * 4)) AS BIGINT) AS v
  FROM embeddings, (SELECT unnest(range({{n}})) AS copy), (SELECT i % 3 AS c, (i // 3) % {SIDE} AS x, i // {3 * SIDE} AS y FROM (SELECT unnest(range({3 * SIDE * SIDE})) AS i)))"""
_HASHES = f"""{_PIXELS},
lum AS (SELECT vec_id, x, y, (sum(v * CASE c WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END)::BIGINT + 32768) >> 16 AS l FROM px GROUP BY ALL),
k AS (SELECT unnest(range(8)) AS k),
t1 AS (SELECT vec_id, i.k AS i, x, sum(l * cos(pi() * i.k * (2 * y + 1) / 64)) AS t FROM lum, k i GROUP BY ALL),
t2 AS (SELECT vec_id, i, j.k AS j, sum(t * cos(pi() * j.k * (2 * x + 1) / 64)) AS s FROM t1, k j GROUP BY ALL),
t3 AS (SELECT vec_id, i, j, CASE WHEN abs(s) < 1e-6 THEN 0 ELSE s END AS s FROM t2),
b AS (SELECT *, s > median(s) OVER (PARTITION BY vec_id) AS bit FROM t3),
h0 AS (SELECT vec_id, sum(CASE WHEN bit THEN CAST(1 AS HUGEINT) << CAST(63 - i * 8 - j AS HUGEINT) ELSE 0 END)::HUGEINT AS h FROM b GROUP BY vec_id),
hashes AS (SELECT vec_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS phash FROM h0)"""


def _cubic_sql(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1 THEN (1.5::DOUBLE * abs({x}) - 2.5::DOUBLE) * abs({x}) * abs({x}) + 1 WHEN abs({x}) < 2 THEN ((-0.5::DOUBLE * abs({x}) + 2.5::DOUBLE) * abs({x}) - 4) * abs({x}) + 2 ELSE 0 END"


#: Whole-numbered weights that take 32 pixels to 8, by the rule of the kernel.
_WEIGHTS = f"""w0 AS (SELECT i, j, {_cubic_sql("((j - (i + 0.5::DOUBLE) * 4 + 0.5::DOUBLE) / 4)")} AS w FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(32)) AS j)),
w1 AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w0 WHERE abs(j + 0.5 - (i + 0.5) * 4) < 8),
wt AS (SELECT i, j, trunc(w * 4194304 + CASE WHEN w < 0 THEN -0.5 ELSE 0.5 END) AS w FROM w1)"""
_ROUNDED = "greatest(0, least(255, floor((sum({v} * w) + 2097152) / 4194304)))"
_DESCRIPTORS = f"""{_PIXELS.format(n=1)}, {_WEIGHTS},
gray AS (SELECT vec_id, x, y, (max(CASE WHEN c = 0 THEN v END) / 255::DOUBLE + max(CASE WHEN c = 1 THEN v END) / 255::DOUBLE + max(CASE WHEN c = 2 THEN v END) / 255::DOUBLE) / 3 AS g,
  trunc((max(CASE WHEN c = 0 THEN v END)::FLOAT / 255::FLOAT + max(CASE WHEN c = 1 THEN v END)::FLOAT / 255::FLOAT + max(CASE WHEN c = 2 THEN v END)::FLOAT / 255::FLOAT) / 3::FLOAT * 255::FLOAT)::DOUBLE AS b FROM px GROUP BY ALL),
step AS (SELECT *, abs(lead(g) OVER (PARTITION BY vec_id, y ORDER BY x) - g) AS dx, abs(lead(g) OVER (PARTITION BY vec_id, x ORDER BY y) - g) AS dy FROM gray),
across AS (SELECT vec_id, y, i, {_ROUNDED.format(v="b")} AS b FROM gray JOIN wt ON j = x GROUP BY ALL),
layout AS (SELECT vec_id, across.i AS x, wt.i AS y, {_ROUNDED.format(v="b")} AS b FROM across JOIN wt ON j = y GROUP BY ALL),
bins AS (SELECT vec_id, c * 16 + least(15, v * 16 // 255) AS place, count(*)::DOUBLE AS x FROM px GROUP BY ALL),
parts AS (SELECT vec_id, place, x FROM bins UNION ALL SELECT vec_id, 48 + y, avg(dx) FROM step GROUP BY ALL UNION ALL SELECT vec_id, 80 + x, avg(dy) FROM step GROUP BY ALL
  UNION ALL SELECT vec_id, 112 + y * 8 + x, b FROM layout UNION ALL SELECT vec_id, 176 + c, avg(v / 255::DOUBLE) FROM px GROUP BY ALL UNION ALL SELECT vec_id, 179 + c, stddev_pop(v / 255::DOUBLE) FROM px GROUP BY ALL
  UNION ALL SELECT vec_id, 182, avg(g) FROM gray GROUP BY ALL UNION ALL SELECT vec_id, 183, stddev_pop(g) FROM gray GROUP BY ALL),
every AS (SELECT vec_id, place, coalesce(x, 0) AS x FROM (SELECT vec_id, unnest(range(184)) AS place FROM embeddings) LEFT JOIN parts USING (vec_id, place)),
descriptors AS (SELECT vec_id, place, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM every)"""
_EMBEDDED = f"""{_PIXELS.format(n=1)}, {_WEIGHTS},
across AS (SELECT vec_id, c, y, i, {_ROUNDED.format(v="v")} AS v FROM px JOIN wt ON j = x GROUP BY ALL),
small AS (SELECT vec_id, (wt.i * 8 + across.i) * 3 + c AS place, {_ROUNDED.format(v="v")} / 255 AS v FROM across JOIN wt ON j = y GROUP BY across.vec_id, c, across.i, wt.i),
middle AS (SELECT vec_id, place, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM small),
units AS (SELECT vec_id, place, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS x FROM middle)"""

_TAGS = f"""{_PIXELS.format(n=1)},
lum AS (SELECT vec_id, x, y, ((sum(v * CASE c WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END)::BIGINT + 32768) >> 16) / 255::DOUBLE AS l FROM px GROUP BY ALL),
s AS (SELECT vec_id, c AS place, avg(v) / 255 AS score FROM px GROUP BY ALL UNION ALL SELECT vec_id, 3, avg(l) FROM lum GROUP BY ALL UNION ALL SELECT vec_id, 4, max(l) - min(l) FROM lum GROUP BY ALL)"""

QUERIES = {
    "picture_tags": (picture_tags, f"WITH {_TAGS} SELECT vec_id, 'curato/colour' AS model_id, CAST(place AS INTEGER) AS place, ['red', 'green', 'blue', 'bright', 'contrast'][place + 1] AS tag, CAST(round(score * 261120) AS BIGINT) AS level, CASE WHEN place < 3 THEN 'general' WHEN place = 3 THEN 'rating' ELSE 'character' END AS model_category, score > CASE WHEN place < 3 THEN 0.35 WHEN place = 3 THEN 0 ELSE 0.85 END AS selected FROM s"),
    "picture_hashes": (picture_hashes, f"WITH {_HASHES.format(n=1)} SELECT vec_id, phash FROM hashes"),
    "picture_hash_pairs": (picture_hash_pairs, f"WITH {_HASHES.format(n=2)}, f AS (SELECT phash, min(vec_id) AS a FROM hashes GROUP BY phash) SELECT least(x.a, y.a) AS a, greatest(x.a, y.a) AS b, CAST(bit_count(xor(x.phash, y.phash)) AS INTEGER) AS distance FROM f x JOIN f y ON x.phash < y.phash AND bit_count(xor(x.phash, y.phash)) <= {NEAR} UNION ALL SELECT a, vec_id, 0 FROM hashes JOIN f USING (phash) WHERE vec_id <> a"),
    "picture_descriptors": (picture_descriptors, f"WITH {_DESCRIPTORS} SELECT vec_id, CAST(place AS INTEGER) AS place, round(x, 6) AS x FROM descriptors"),
    "picture_embeddings": (picture_embeddings, f"WITH {_EMBEDDED} SELECT vec_id, round(max(x), 6) AS most, CAST(arg_min(place, (-round(x, 9), place)) AS INTEGER) AS place, round(abs(sum(x)), 6) AS total, round(sum(x * x), 6) AS length FROM units GROUP BY vec_id"),
}
