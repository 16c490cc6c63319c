"""Queries on rasters cut into tiles, on image files in the shared folder, and on quantile sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_parts
from ..operators import images as U
from ..operators import sketches as K
from ..operators import tiles as T
from ..sources import files
from ..sources.shared import shared_folder, written
from ..sources.sinks import bitmap, write_files
from .registry import query
from .standins import table

WIDTH, LEVEL, LEAST, SIDE, KERNEL = 64, 0.12, 3, 16, 9


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings as one raster: a row of pixels each, so one image grows with the data."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return e.select(F.lit(0).alias("id"), (F.col("vec_id") * WIDTH + F.col("x")).alias("pos"), F.col("v").cast("double").alias("score"))


RASTER = f"px AS (SELECT vec_id AS y, unnest(range(len(embedding))) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings), size AS (SELECT max(y) + 1 AS h, {WIDTH} AS w FROM px)"


@query(f"""WITH RECURSIVE {RASTER}, m AS (SELECT y, x, y * {WIDTH} + x AS p FROM px WHERE v > {LEVEL}::DOUBLE), d AS (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dx),
e AS (SELECT a.p AS a, b.p AS b FROM m a, d, m b WHERE b.y = a.y + d.dy AND b.x = a.x + d.dx), r AS (SELECT p, p AS root FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.p),
c AS (SELECT p, min(root) AS root FROM r GROUP BY 1) SELECT min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM m JOIN c USING (p) GROUP BY root HAVING count(*) >= {LEAST}""")
def tiled_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Connected regions of one large raster, over tiles of 16 by 16."""
    out = T.mask_regions(raster(spark, sf), LEVEL, WIDTH, LEAST, tile=SIDE)
    return out.select("x1", "y1", "x2", "y2", "area", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


_WEIGHTS = ", ".join(f"{w!r}::DOUBLE" for w in T.gaussian(KERNEL).tolist())


@query(f"""WITH {RASTER}, k AS (SELECT unnest(range(-{KERNEL // 2}, {KERNEL // 2 + 1})) AS d, unnest([{_WEIGHTS}]) AS g),
a AS (SELECT o.y, o.x, sum(g * s.v) AS v FROM px o, k, size, px s WHERE s.x = o.x AND s.y = CASE WHEN abs(o.y + d) < h THEN abs(o.y + d) ELSE 2 * (h - 1) - abs(o.y + d) END GROUP BY 1, 2),
b AS (SELECT o.y, o.x, sum(g * s.v) AS v FROM a o, k, size, a s WHERE s.y = o.y AND s.x = CASE WHEN abs(o.x + d) < w THEN abs(o.x + d) ELSE 2 * (w - 1) - abs(o.x + d) END GROUP BY 1, 2)
SELECT y * {WIDTH} + x AS pos, round(v, 6) AS score FROM b""")
def tiled_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussian smoothing of one large raster, over tiles of 16 by 16 with the pixels around them."""
    height = table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
    out = T.smooth_map(raster(spark, sf), WIDTH, (height or 0) + 1, KERNEL, tile=SIDE)
    return out.select("pos", F.round("score", 6).alias("score"))


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("SELECT event_type, count(value) AS n, true AS p50_within, true AS p95_within, true AS p99_within FROM events GROUP BY 1")
def latency_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches by day and type, kept as a table and merged by type: are their quantiles within the stated rank error?"""
    e = table(spark, sf, "events")
    kept = written(K.quantile_sketches(e, "value", [F.to_date("ts").alias("day"), "event_type"]), "sketches")
    told = K.sketch_quantiles(K.merge_sketches(kept, ["event_type"]), SHARES)
    met = e.select("event_type", "value").join(told, "event_type")
    upto = [F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_le") for p in SHARES] + [F.count_if(F.col("value") < F.col(p)).alias(f"{p}_lt") for p in SHARES]
    counts = met.groupBy("event_type", "n").agg(*upto)
    slack = 2 * K.rank_error() * F.col("n") + 1
    return counts.select("event_type", "n", *[((F.col(f"{p}_lt") <= q * F.col("n") + slack) & (F.col(f"{p}_le") >= q * F.col("n") - slack)).alias(f"{p}_within") for p, q in SHARES.items()])


@query("SELECT 'image' AS kind, count(*) AS n, true AS within FROM embeddings UNION ALL SELECT 'position', sum(len(embedding)), true FROM embeddings")
def threshold_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds of image and position scores from sketches by label that are merged, against exact ranks."""
    e = table(spark, sf, "embeddings")
    deep = e.select("label", F.explode("embedding").alias("v")).select(F.lit("position").alias("kind"), "label", F.abs("v").cast("double").alias("score"))
    flat = e.select(F.lit("image").alias("kind"), "label", F.array_max(F.transform("embedding", F.abs)).cast("double").alias("score"))
    scores = deep.unionByName(flat)
    kept = written(K.quantile_sketches(scores, "score", ["kind", "label"]), "sketches")
    told = K.sketch_quantiles(K.merge_sketches(kept, ["kind"]), {"t": 0.99})
    counts = scores.join(told, "kind").groupBy("kind", "n").agg(F.count_if(F.col("score") <= F.col("t")).alias("le"), F.count_if(F.col("score") < F.col("t")).alias("lt"))
    slack = 2 * K.rank_error() * F.col("n") + 1
    return counts.select("kind", "n", ((F.col("lt") <= 0.99 * F.col("n") + slack) & (F.col("le") >= 0.99 * F.col("n") - slack)).alias("within"))


#: Vectors that one image file holds, a row of pixels each.
ROWS = 64


def image_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as bitmap files of 64 by 64 grey pixels: stem and data. Rows without a vector are black; every fifth file
    is no image. Files with an even number lie in <split>/images, the others in images/<split>."""
    e = table(spark, sf, "embeddings").withColumn("k", F.floor(F.col("vec_id") / ROWS).cast("long"))
    level = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * 300 + 128, F.lit(255.0)), F.lit(0.0))).cast("int"))
    rows = e.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct((F.col("vec_id") % ROWS).cast("int").alias("y"), level.alias("v")))).alias("m"))
    black = F.array_repeat(F.lit(0), WIDTH)
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda y: F.coalesce(F.element_at("m", y), black)))
    data = F.when(F.col("k") % 5 == 3, F.encode(F.concat(F.lit("no image "), F.col("k").cast("string")), "utf-8")).otherwise(bitmap(whole, WIDTH, ROWS))
    path = F.when(F.col("k") % 2 == 0, F.concat(F.lit("train/images/"), F.col("k").cast("string"), F.lit(".bmp"))).otherwise(F.concat(F.lit("images/val/"), F.col("k").cast("string"), F.lit(".bmp")))
    return rows.select(path.alias("path"), data.alias("data"))


def image_folder(spark: SparkSession, sf: str) -> str:
    root = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    write_files(image_bytes(spark, sf), root)
    return root


HEADER = "'424d' || '36300000' || '00000000' || '36000000' || '28000000' || '40000000' || '40000000' || '0100' || '1800' || '00000000' || '00300000' || '130b0000' || '130b0000' || '00000000' || '00000000'"
IMAGES = f"""e AS (SELECT vec_id // {ROWS} AS k, vec_id % {ROWS} AS y, list_transform(embedding, lambda x: floor(greatest(least(x::DOUBLE * 300 + 128, 255), 0))::INT) AS v FROM embeddings),
ys AS (SELECT k, unnest(range(0, {ROWS})) AS y FROM (SELECT DISTINCT k FROM e)),
img AS (SELECT k, list(coalesce(v, list_transform(range(0, {WIDTH}), lambda i: 0)) ORDER BY ys.y) AS rows FROM ys LEFT JOIN e USING (k, y) GROUP BY k),
hexed AS (SELECT k, rows, {HEADER} || array_to_string(list_transform(list_reverse(rows), lambda r: array_to_string(list_transform(r, lambda x: repeat(printf('%02x', x), 3)), '')), '') AS h FROM img),
files AS (SELECT k, rows, k % 5 = 3 AS broken, CASE WHEN k % 5 = 3 THEN ('no image ' || k)::BLOB ELSE from_hex(h) END AS data FROM hexed)"""


@query(f"WITH {IMAGES} SELECT k::VARCHAR AS stem, CASE WHEN k % 2 = 0 THEN 'train' ELSE 'val' END AS split, '.bmp' AS suffix, octet_length(data) AS length, md5(data) AS md5, true AS supported FROM files")
def image_files(spark: SparkSession, sf: str) -> DataFrame:
    """Image files in the shared folder, scanned in both layouts."""
    return files.scan_dataset(spark, image_folder(spark, sf)).select("stem", "split", "suffix", "length", "md5", "supported")


@query(f"WITH {IMAGES} SELECT k::VARCHAR AS stem, CASE WHEN broken THEN -1 ELSE {WIDTH} END AS width, CASE WHEN broken THEN -1 ELSE {ROWS} END AS height, CASE WHEN broken THEN 'CORRUPT_IMAGE' END AS issue FROM files")
def decoded_images(spark: SparkSession, sf: str) -> DataFrame:
    """The same files decoded; those that cannot be are rows with an issue."""
    out = files.decode_images(spark, image_folder(spark, sf))
    return out.select(path_parts(F.col("origin"))["stem"].alias("stem"), "width", "height", "issue")


_AT = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 63 THEN 126 - ({0}) ELSE {0} END"
PIXELS = f"""{IMAGES}, p AS (SELECT k, y, unnest(range(0, {WIDTH})) AS x, unnest(r) AS v FROM (SELECT k, unnest(range(0, {ROWS})) AS y, unnest(rows) AS r FROM files WHERE NOT broken)),
d AS (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dx, unnest([-1, 0, 1, -2, 2, -1, 0, 1]) AS gx, unnest([-1, -2, -1, 0, 0, 1, 2, 1]) AS gy),
s AS (SELECT a.k, a.y, a.x, sum(gx * b.v) AS sx, sum(gy * b.v) AS sy FROM p a, d, p b WHERE b.k = a.k AND b.y = {_AT.format("(a.y + dy)")} AND b.x = {_AT.format("(a.x + dx)")} GROUP BY 1, 2, 3),
l AS (SELECT k, v, CASE WHEN v / 255 > 0.04045::DOUBLE THEN ((v / 255 + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4::DOUBLE ELSE v / 255 / 12.92::DOUBLE END AS c FROM p)"""


@query(f"""WITH {PIXELS}, f AS (SELECT k, 0 AS channel, (CASE WHEN c > 0.008856::DOUBLE THEN 116 * cbrt(c) - 16 ELSE 903.3::DOUBLE * c END) * 255 / 100 AS value FROM l UNION ALL SELECT k, unnest([1, 2]), 128 FROM l UNION ALL SELECT k, 3, sqrt(sx * sx + sy * sy) FROM s)
SELECT k::VARCHAR AS stem, channel, count(*) AS n, round(avg(value), 4) AS mean, round(max(value), 4) AS most FROM f GROUP BY ALL""")
def image_pixel_features(spark: SparkSession, sf: str) -> DataFrame:
    """Lightness, colour and gradient of all pixels of the decoded files, by file and channel."""
    good = files.decode_images(spark, image_folder(spark, sf)).where("issue is null")
    each = U.pixel_features(good, WIDTH).groupBy("origin", "channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.max("value"), 4).alias("most"))
    return each.select(path_parts(F.col("origin"))["stem"].alias("stem"), "channel", "n", "mean", "most")


@query(f"""WITH {IMAGES}, p AS (SELECT k, unnest(r) AS v FROM (SELECT k, unnest(rows) AS r FROM files WHERE NOT broken)), h AS (SELECT k, v, count(*) AS n FROM p GROUP BY 1, 2),
u AS (SELECT k, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY k) AS nt, sum(n * v) OVER (PARTITION BY k) AS st FROM h WINDOW w AS (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING)),
t AS (SELECT k, arg_min(v, {{'b': -CASE WHEN nt > n0 THEN n0::DOUBLE * (nt - n0) * (s0::DOUBLE / n0 - (st - s0)::DOUBLE / (nt - n0)) ** 2 ELSE 0 END, 'v': v}}) AS t FROM u GROUP BY 1)
SELECT k::VARCHAR AS stem, count(*) AS dark_pixels FROM p JOIN t USING (k) WHERE v <= t GROUP BY 1""")
def image_dark_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions below each file's Otsu threshold; compared by how many pixels they hold together."""
    good = files.decode_images(spark, image_folder(spark, sf)).where("issue is null")
    each = U.extract_regions(good).groupBy("origin").agg(F.sum("area").cast("long").alias("dark_pixels"))
    return each.select(path_parts(F.col("origin"))["stem"].alias("stem"), "dark_pixels")
