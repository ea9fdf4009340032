"""Queries on field arrays and their previews."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import grids
from tidemark.functions.exprs import html_safe_json, max_abs, total
from tidemark.functions.ordered import with_dense_neighbors
from tidemark.operators import fields, integrity, preview, summary
from tidemark.session import widen
from tidemark.sources import driver_tables as dt
from tidemark.suite import query
from tidemark.suite.integrity import PROBLEM_SQL

PI = repr(math.pi)


@query(
    "burgers_frame_diagnostics",
    dt.with_views("frames")
    + """ SELECT run_id, frame, time, round(list_sum(vals) / 64, 9) AS mean_velocity, round(list_sum(vals), 8) AS mass,
  round(0.5 * list_sum(list_transform(vals, lambda v: v * v)) / 64, 9) AS energy FROM frames""",
)
def burgers_frame_diagnostics(spark, sf_dir):
    out = fields.burgers_diagnostics(dt.frames(spark, sf_dir), F.lit(64.0))
    return out.select(
        "run_id",
        "frame",
        "time",
        F.round("mean_velocity", 9).alias("mean_velocity"),
        F.round("mass", 8).alias("mass"),
        F.round("energy", 9).alias("energy"),
    )


def squares(spark, sf_dir):
    """8x8 flow fields: u is a saved vector, v and the vorticity are the next two."""
    base = dt.frames(spark, sf_dir).select("run_id", "frame", "time", F.col("values").alias("u"))
    one = with_dense_neighbors(base, ["run_id"], "frame", next={"v": "u"})
    two = with_dense_neighbors(one, ["run_id"], "frame", next={"vorticity": "v"})
    return two.filter(F.col("vorticity").isNotNull()).withColumn("nx", F.lit(8))


# On a real grid of even size, the derivative of the interpolating Fourier sum is a circular
# convolution with alternating halves of cotangents.
@query(
    "navier_stokes_frame_diagnostics",
    dt.with_views("frames")
    + """, flow AS (SELECT run_id, frame, time, vals AS u, lead(vals, 1) OVER w AS v, lead(vals, 2) OVER w AS o
  FROM frames WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
kernel AS (SELECT list(CASE WHEN m = 0 THEN 0 ELSE (CASE WHEN m % 2 = 0 THEN 0.5 ELSE -0.5 END) / tan(m * pi() / 8) END ORDER BY m) AS c
  FROM range(8) t(m))
SELECT run_id, frame, time, round(list_sum(o) / 64, 9) AS mean_vorticity, round(list_sum(o) / 64 * 2 * pi() * 2 * pi(), 9) AS circulation,
  round(0.5 * (list_sum(list_transform(u, lambda x: x * x)) + list_sum(list_transform(v, lambda x: x * x))) / 64, 9) AS energy,
  round(0.5 * list_sum(list_transform(o, lambda x: x * x)) / 64, 9) AS enstrophy,
  round(list_max(list_transform(range(64), lambda i: abs(list_sum(list_transform(range(8), lambda k:
    c[(i % 8 - k + 8) % 8 + 1] * u[i // 8 * 8 + k + 1] + c[(i // 8 - k + 8) % 8 + 1] * v[k * 8 + i % 8 + 1]))))), 9) AS max_abs_divergence
FROM flow, kernel WHERE o IS NOT NULL""",
)
def navier_stokes_frame_diagnostics(spark, sf_dir):
    out = fields.navier_stokes_diagnostics(squares(spark, sf_dir), F.lit(2 * math.pi))
    measures = ("mean_vorticity", "circulation", "energy", "enstrophy", "max_abs_divergence")
    return out.select("run_id", "frame", "time", *[F.round(c, 9).alias(c) for c in measures])


@query(
    "navier_stokes_moments",
    dt.with_views("frames")
    + """, flow AS (SELECT run_id, frame, time, vals AS u, lead(vals, 1) OVER w AS v, lead(vals, 2) OVER w AS o
  FROM frames WINDOW w AS (PARTITION BY run_id ORDER BY frame))
SELECT run_id, frame, time, round(list_sum(o) / 64, 9) AS mean_vorticity, round(list_sum(o) / 16, 9) AS circulation,
  round(0.5 * (list_sum(list_transform(u, lambda x: x * x)) + list_sum(list_transform(v, lambda x: x * x))) / 64, 9) AS energy,
  round(0.5 * list_sum(list_transform(o, lambda x: x * x)) / 64, 9) AS enstrophy
FROM flow WHERE o IS NOT NULL""",
)
def navier_stokes_moments(spark, sf_dir):
    out = fields.navier_stokes_diagnostics(squares(spark, sf_dir), F.lit(2.0))
    return out.select(
        "run_id",
        "frame",
        "time",
        *[
            F.round(c, 9).alias(c)
            for c in ("mean_vorticity", "circulation", "energy", "enstrophy")
        ],
    )


@query(
    "stability_screen_1d",
    dt.with_views("frames")
    + """, rated AS (SELECT run_id, frame, list_max(list_transform(vals, lambda v: abs(v))) / 0.5 + 2 * 0.05::DOUBLE / 0.25 AS rate FROM frames)
SELECT run_id, frame, round(rate, 9) AS rate, CASE WHEN 0.5 * rate > 0.5 THEN 'bound exceeded' END AS problem,
  round(0.5 / rate, 9) AS suggested_dt FROM rated""",
)
def stability_screen_1d(spark, sf_dir):
    frames = dt.frames(spark, sf_dir)
    rate = grids.stability_rate_1d("values", F.lit(0.5), F.lit(0.05))
    out = fields.stability_screen(frames, rate, F.lit(0.5))
    return out.select(
        "run_id",
        "frame",
        F.round("rate", 9).alias("rate"),
        "problem",
        F.round("suggested_dt", 9).alias("suggested_dt"),
    )


@query(
    "stability_screen_2d",
    dt.with_views("frames")
    + f""", flow AS (SELECT run_id, frame, vals AS u, lead(vals, 1) OVER w AS v, lead(vals, 2) OVER w AS o
  FROM frames WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
rated AS (SELECT run_id, frame, (list_max(list_transform(u, lambda x: abs(x))) + list_max(list_transform(v, lambda x: abs(x))))
    * (2 * {PI}::DOUBLE / 4.0::DOUBLE * 2) + 0.01::DOUBLE * 2 * (2 * {PI}::DOUBLE / 4.0::DOUBLE * 2) * (2 * {PI}::DOUBLE / 4.0::DOUBLE * 2) AS rate
  FROM flow WHERE o IS NOT NULL)
SELECT run_id, frame, round(rate, 8) AS rate, CASE WHEN 0.25::DOUBLE * rate > 0.5 THEN 'bound exceeded' END AS problem FROM rated""",
)
def stability_screen_2d(spark, sf_dir):
    rate = grids.stability_rate_2d("u", "v", F.col("nx"), F.lit(4.0), F.lit(0.01))
    out = fields.stability_screen(squares(spark, sf_dir), rate, F.lit(0.25))
    return out.select("run_id", "frame", F.round("rate", 8).alias("rate"), "problem")


@query(
    "burgers_rhs",
    dt.with_views("frames")
    + """, flux AS (SELECT run_id, frame, list_transform(range(0, 64), lambda i:
    -(0.5 * vals[(i + 1) % 64 + 1] * vals[(i + 1) % 64 + 1] - 0.5 * vals[(i + 63) % 64 + 1] * vals[(i + 63) % 64 + 1]) / 0.5
    + 0.05::DOUBLE * (vals[(i + 1) % 64 + 1] - 2 * vals[i + 1] + vals[(i + 63) % 64 + 1]) / 0.0625) AS rhs FROM frames)
SELECT run_id, frame, round(rhs[1], 7) AS first_cell, round(rhs[64], 7) AS last_cell,
  round(list_max(list_transform(rhs, lambda v: abs(v))), 7) AS peak, round(abs(list_sum(rhs)), 7) < 1e-6 AS conservative FROM flux""",
)
def burgers_rhs(spark, sf_dir):
    out = fields.with_rhs(dt.frames(spark, sf_dir), F.lit(0.25), F.lit(0.05))
    return out.select(
        "run_id",
        "frame",
        F.round(F.get("rhs", F.lit(0)), 7).alias("first_cell"),
        F.round(F.get("rhs", F.lit(63)), 7).alias("last_cell"),
        F.round(max_abs("rhs"), 7).alias("peak"),
        (F.round(F.abs(total("rhs")), 7) < 1e-6).alias("conservative"),
    )


@query(
    "saved_frame_residuals",
    dt.with_views("frames")
    + """, around AS (SELECT run_id, frame, vals, lag(vals) OVER w AS b, lead(vals) OVER w AS a FROM frames
  WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
res AS (SELECT run_id, frame, list_transform(range(0, 64), lambda i: (a[i + 1] - b[i + 1]) / 1.0::DOUBLE
    + vals[i + 1] * (vals[(i + 1) % 64 + 1] - vals[(i + 63) % 64 + 1]) / 0.5
    - 0.05::DOUBLE * (vals[(i + 1) % 64 + 1] - 2 * vals[i + 1] + vals[(i + 63) % 64 + 1]) / 0.0625) AS r
  FROM around WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT run_id, frame, round(sqrt(list_sum(list_transform(r, lambda v: v * v)) / 64), 8) AS residual_rms FROM res""",
)
def saved_frame_residuals(spark, sf_dir):
    out = fields.saved_frame_residuals(
        dt.frames(spark, sf_dir), F.lit(0.5), F.lit(0.25), F.lit(0.05)
    )
    return out.select("run_id", "frame", F.round("residual_rms", 8).alias("residual_rms"))


def plates(spark, sf_dir):
    """Closed-form Darcy plates, one per part; the pressure carries a known error."""
    n = (5 + 4 * (F.col("p_size") % 4)).cast("int")
    p = dt.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("run_id"),
        n.alias("n"),
        (1.0 + F.col("p_partkey") % 3).alias("length"),
        ((F.col("p_partkey") % 8) / 10.0).alias("contrast"),
    )
    p = widen(p).withColumn("exact", grids.plate_pressure(F.col("n")))
    return p.withColumns(
        {
            "permeability": grids.plate_permeability(F.col("exact"), F.col("contrast")),
            "forcing": grids.plate_forcing(F.col("n"), F.col("length"), F.col("contrast")),
            "pressure": F.transform("exact", lambda v, i: v * (1 + F.pmod(i, F.lit(3)) / 100.0)),
        }
    )


PLATE_SQL = f"""WITH given AS (SELECT p_partkey AS run_id, 5 + 4 * (p_size % 4) AS n, 1.0::DOUBLE + p_partkey % 3 AS length,
    (p_partkey % 8) / 10.0::DOUBLE AS contrast FROM part),
cells AS (SELECT run_id, n, length, contrast, i % n AS ix, i // n AS iy, i, {PI}::DOUBLE * (i % n) / (n - 1) AS px, {PI}::DOUBLE * (i // n) / (n - 1) AS py
  FROM given, LATERAL (SELECT unnest(range(0, n * n)) AS i)),
field AS (SELECT *, CASE WHEN ix IN (0, n - 1) OR iy IN (0, n - 1) THEN 0.0::DOUBLE ELSE sin(px) * sin(py) END AS exact,
    ({PI}::DOUBLE / length) * ({PI}::DOUBLE / length) AS k2 FROM cells),
plate AS (SELECT *, 1 + contrast * exact AS a, exact * (1 + (i % 3) / 100.0::DOUBLE) AS p,
    2 * k2 * (1 + contrast * exact) * exact - contrast * k2 * (cos(px)*cos(px)*sin(py)*sin(py) + sin(px)*sin(px)*cos(py)*cos(py)) AS f
  FROM field)"""


@query(
    "darcy_diagnostics",
    PLATE_SQL
    + """, faces AS (SELECT *, lag(a) OVER x AS aw, lead(a) OVER x AS ae, lag(a) OVER y AS asouth, lead(a) OVER y AS anorth,
    lag(p) OVER x AS pw, lead(p) OVER x AS pe, lag(p) OVER y AS ps, lead(p) OVER y AS pn, length / (n - 1) AS h
  FROM plate WINDOW x AS (PARTITION BY run_id, iy ORDER BY ix), y AS (PARTITION BY run_id, ix ORDER BY iy)),
residual AS (SELECT *, CASE WHEN ix > 0 AND ix < n - 1 AND iy > 0 AND iy < n - 1 THEN
    (2*a*ae/(a+ae)*(p-pe) + 2*a*aw/(a+aw)*(p-pw) + 2*a*anorth/(a+anorth)*(p-pn) + 2*a*asouth/(a+asouth)*(p-ps)) / (h*h) - f END AS r
  FROM faces)
SELECT run_id, n, round(sqrt(avg(r * r)), 7) AS residual_l2, round(any_value(h) * sqrt(sum((p - exact) * (p - exact))), 9) AS pressure_l2_error
FROM residual GROUP BY run_id, n""",
)
def darcy_diagnostics(spark, sf_dir):
    out = fields.darcy_diagnostics(plates(spark, sf_dir))
    return out.select(
        "run_id",
        "n",
        F.round("residual_l2", 7).alias("residual_l2"),
        F.round("pressure_l2_error", 9).alias("pressure_l2_error"),
    )


@query(
    "closed_form_fields",
    f"""WITH given AS (SELECT p_partkey AS run_id, 8 * (1 + p_size % 4) AS n, p_retailprice / 1000 AS amp, p_size / 10.0::DOUBLE AS t FROM part)
SELECT run_id, n, round(0.5 * list_sum(list_transform(range(0, n), lambda i: power(amp * sin(2 * {PI}::DOUBLE * (i / n)), 2))) / n, 10) AS sine_energy,
  round(0.5 * list_sum(list_transform(range(0, n * n), lambda i: power(2 * amp * (2 * {PI}::DOUBLE / 4) * exp(-2 * 0.05::DOUBLE * (2 * {PI}::DOUBLE / 4) * (2 * {PI}::DOUBLE / 4) * t)
     * sin(2 * {PI}::DOUBLE / n * (i % n)) * sin(2 * {PI}::DOUBLE / n * (i // n)), 2))) / (n * n), 8) AS vortex_enstrophy
FROM given""",
)
def closed_form_fields(spark, sf_dir):
    p = dt.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("run_id"),
        (8 * (1 + F.col("p_size") % 4)).alias("n"),
        (F.col("p_retailprice") / 1000).alias("amp"),
        (F.col("p_size") / 10.0).alias("t"),
    )
    n, amp = F.col("n"), F.col("amp")
    shaped = p.withColumns(
        {
            "sine": grids.sine_field(n, amp),
            "vortex": grids.taylor_green_vorticity(n, amp, F.lit(4.0), F.lit(0.05), F.col("t")),
        }
    )
    return shaped.select(
        "run_id",
        "n",
        F.round(grids.half_mean_square("sine"), 10).alias("sine_energy"),
        F.round(grids.half_mean_square("vortex"), 8).alias("vortex_enstrophy"),
    )


@query(
    "refined_reference_error",
    f"""WITH given AS (SELECT p_partkey AS run_id, 8 * (1 + p_size % 3) AS n, p_retailprice / 1000 AS amp FROM part)
SELECT run_id, n, round(sqrt(list_sum(list_transform(range(0, n), lambda i: power(1.01::DOUBLE * amp * sin(2 * {PI}::DOUBLE * (i / n))
   - amp * sin(2 * {PI}::DOUBLE * ((i * (48 // n)) / 48)), 2))) / n), 9) AS error FROM given WHERE n IN (8, 16, 24)""",
)
def refined_reference_error(spark, sf_dir):
    p = dt.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("run_id"),
        (8 * (1 + F.col("p_size") % 3)).alias("n"),
        (F.col("p_retailprice") / 1000).alias("amp"),
    )
    amp = F.col("amp")
    shaped = p.withColumns(
        {
            "reference": grids.sine_field(F.lit(48), amp),
            "solution": grids.sine_field(F.col("n"), F.lit(1.01) * amp),
        }
    )
    return shaped.select(
        "run_id",
        "n",
        F.round(grids.subsample_error("reference", "solution"), 9).alias("error"),
    )


@query(
    "mean_preserving_update",
    dt.with_views("frames")
    + """, step AS (SELECT run_id, frame, vals, lead(vals) OVER (PARTITION BY run_id ORDER BY frame) AS d FROM frames)
SELECT run_id, frame, round(list_sum(vals) / 64, 9) AS mean_before, round(list_sum(vals) / 64, 9) AS mean_after,
  round(vals[1] + d[1] - list_sum(d) / 64, 9) AS first_cell FROM step WHERE d IS NOT NULL""",
)
def mean_preserving_update(spark, sf_dir):
    pairs = with_dense_neighbors(
        dt.frames(spark, sf_dir).select("run_id", "frame", "values"),
        ["run_id"],
        "frame",
        next={"increment": "values"},
    ).filter(F.col("increment").isNotNull())
    updated = pairs.withColumn("updated", grids.mean_preserving_update("values", "increment"))
    return updated.select(
        "run_id",
        "frame",
        F.round(total("values") / 64, 9).alias("mean_before"),
        F.round(total("updated") / 64, 9).alias("mean_after"),
        F.round(F.get("updated", F.lit(0)), 9).alias("first_cell"),
    )


@query(
    "final_frames",
    dt.with_views("frames")
    + """ SELECT run_id, field, max(frame) AS frame, arg_max(label, frame) AS label, arg_max(vals[1], frame) AS first_cell
FROM frames GROUP BY run_id, field""",
)
def final_frames(spark, sf_dir):
    return summary.final_frames(dt.frames(spark, sf_dir)).select(
        "run_id", "field", "frame", "label", F.get("values", F.lit(0)).alias("first_cell")
    )


@query(
    "partial_read",
    dt.with_views("frames")
    + """ SELECT run_id, frame, len(vals[1:32]) AS cells, vals[1] AS first_cell, vals[32] AS last_cell
FROM frames WHERE run_id = 7 AND frame = 24""",
)
def partial_read(spark, sf_dir):
    return fields.read_tile(dt.frames(spark, sf_dir), run_id=7, frame=24, cols=32).select(
        "run_id",
        "frame",
        F.size("values").alias("cells"),
        F.get("values", F.lit(0)).alias("first_cell"),
        F.get("values", F.lit(31)).alias("last_cell"),
    )


@query(
    "cell_chunks",
    dt.with_views("frames")
    + """ SELECT run_id, (i // 16) AS chunk, count(*) AS cells, round(max(v), 9) AS top FROM
  (SELECT run_id, unnest(range(0, 64)) AS i, unnest(vals) AS v FROM frames) GROUP BY run_id, i // 16""",
)
def cell_chunks(spark, sf_dir):
    cells = fields.long_cells(dt.frames(spark, sf_dir))
    return cells.groupBy("run_id", integrity.chunk_of(F.col("ix"), 16).alias("chunk")).agg(
        F.count("*").alias("cells"), F.round(F.max("value"), 9).alias("top")
    )


@query(
    "frame_gaps",
    dt.with_views("diagnostics")
    + """ SELECT run_id, count(*) AS saved, max(frame) AS last, max(frame) + 1 - count(*) AS missing FROM diagnostics
GROUP BY run_id HAVING max(frame) + 1 > count(*)""",
)
def frame_gaps(spark, sf_dir):
    return fields.frame_gaps(dt.diagnostics(spark, sf_dir))


@query(
    "array_problems",
    """WITH f AS (SELECT vec_id // 25 AS run_id, CASE WHEN (vec_id // 25) % 7 = 3 THEN '9bad' ELSE 'velocity' END AS field,
    vec_id % 25 AS frame, CASE WHEN vec_id % 59 = 0 THEN 63 ELSE 64 END AS cells FROM embeddings WHERE vec_id % 83 <> 0),
g AS (SELECT run_id, field, count(*) AS n, max(frame) AS top, min(frame) AS low, min(cells) AS a, max(cells) AS b FROM f GROUP BY run_id, field)
SELECT run_id, field, CASE WHEN field = '9bad' THEN 'unsafe array name' WHEN a <> b THEN 'ragged frames'
  ELSE 'does not match the saved time dimension' END AS problem FROM g WHERE field = '9bad' OR a <> b OR low <> 0 OR top + 1 <> n""",
)
def array_problems(spark, sf_dir):
    from tidemark.sources.catalog import array_problems as check

    vec = F.col("vec_id")
    frames = dt.table(spark, sf_dir, "embeddings").filter(vec % 83 != 0)
    frames = frames.select(
        F.expr("vec_id div 25").alias("run_id"),
        F.when(F.expr("vec_id div 25") % 7 == 3, "9bad").otherwise("velocity").alias("field"),
        (vec % 25).alias("frame"),
        F.when(vec % 59 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("values"),
    )
    return check(frames)


# -- previews ---------------------------------------------------------------------


@query(
    "diagnostic_samples",
    """WITH s AS (SELECT l_orderkey // 512 AS run_id, l_orderkey % 512 AS frame, max(l_quantity) AS energy FROM lineitem GROUP BY l_orderkey),
numbered AS (SELECT run_id, energy, row_number() OVER (PARTITION BY run_id ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM s),
wanted AS (SELECT run_id, n, pos, energy FROM numbered
  WHERE n <= 201 OR list_contains(list_transform(range(0, 201), lambda i: (i * (n - 1)) // 200), pos))
SELECT run_id, n AS source_samples, count(*) AS display_samples, min(pos) AS first_pos, max(pos) AS last_pos,
  CAST(sum(pos) AS BIGINT) AS pos_sum, CAST(sum(energy) AS BIGINT) AS energy_sum FROM wanted GROUP BY run_id, n""",
)
def diagnostic_samples(spark, sf_dir):
    s = (
        dt.table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.max("l_quantity").alias("energy"))
        .select(
            F.expr("l_orderkey div 512").alias("run_id"),
            F.lit(0).alias("one"),
            (F.col("l_orderkey") % 512).alias("at"),
            "energy",
        )
    )
    from pyspark.sql import Window

    # A run of this view has at most 512 saved positions.
    frame = F.row_number().over(Window.partitionBy("run_id").orderBy("at")) - 1
    series = s.withColumn("frame", frame).withColumn("time", F.col("frame") * 0.5)
    out = preview.series_preview(series)
    pos = F.transform("samples", lambda x: x["frame"].cast("long"))
    return out.select(
        "run_id",
        "source_samples",
        "display_samples",
        F.array_min(pos).alias("first_pos"),
        F.array_max(pos).alias("last_pos"),
        F.aggregate(pos, F.lit(0).cast("long"), lambda a, x: a + x).alias("pos_sum"),
        F.aggregate(
            "samples", F.lit(0).cast("long"), lambda a, x: a + x["value"].cast("long")
        ).alias("energy_sum"),
    )


@query(
    "field_preview",
    """WITH wide AS (SELECT vec_id // 25 AS run_id, vec_id % 25 AS frame, list_concat(embedding, embedding, embedding, embedding, embedding, embedding, embedding, embedding)::DOUBLE[] AS vals FROM embeddings)
SELECT run_id, frame, 2 AS stride_x, 256 AS shown, round(list_sum(list_transform(range(0, 256), lambda i: vals[2 * i + 1])), 8) AS preview_sum FROM wide""",
)
def field_preview(spark, sf_dir):
    wide = dt.frames(spark, sf_dir).select(
        "run_id",
        "frame",
        F.lit(1).alias("ny"),
        F.lit(512).alias("nx"),
        F.flatten(F.array_repeat("values", 8)).alias("values"),
    )
    out = preview.field_preview(wide)
    return out.select(
        "run_id",
        "frame",
        F.get("strides", F.lit(1)).alias("stride_x"),
        F.get("display_shape", F.lit(1)).alias("shown"),
        F.round(total("preview"), 8).alias("preview_sum"),
    )


@query(
    "escaped_payloads",
    """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e'),
  chr(8232), '\\u2028'), chr(8233), '\\u2029')) AS payload_sha256,
  octet_length(encode(replace(replace(replace(html, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e'))) > 33554432 AS too_big FROM pages""",
)
def escaped_payloads(spark, sf_dir):
    safe = html_safe_json("html")
    return dt.table(spark, sf_dir, "pages").select(
        "page_id",
        F.sha2(safe, 256).alias("payload_sha256"),
        (F.octet_length(safe) > preview.MAX_PAYLOAD_BYTES).alias("too_big"),
    )


def _snapshot(spark, sf_dir, intact):
    runs = dt.runs(spark, sf_dir)
    with_prefix = lambda df: df.withColumn("run_id", F.concat(F.lit("run-"), "run_id"))
    problems = with_prefix(
        integrity.artifact_problems(dt.manifest_entries(spark, sf_dir), dt.artifacts(spark, sf_dir))
    )
    if intact:
        runs = runs.join(problems.select(F.col("run_id").alias("id")), "id", "left_anti")
    digests = runs.select(
        "id",
        F.sha2(F.concat_ws("|", "id", "status"), 256).alias("manifest_sha256"),
        F.sha2(F.concat_ws("|", "id", "equation"), 256).alias("record_sha256"),
    )
    series = with_prefix(dt.diagnostics(spark, sf_dir).select("run_id", "frame", "time", "energy"))
    finals = with_prefix(summary.final_frames(dt.frames(spark, sf_dir)))
    return preview.catalog_snapshot(runs, problems, digests, series, finals, 50)


# Among the first runs of the test tables are corrupt ones, so no row has a payload; were all of
# them sound, this would state so and not their payloads.
@query(
    "catalog_snapshot",
    dt.with_views("runs", "manifest", "artifacts")
    + PROBLEM_SQL
    + """, chosen AS (SELECT id FROM runs ORDER BY id LIMIT 50),
stopped AS (SELECT count(*) > 0 AS corrupt FROM problems WHERE concat('run-', run_id) IN (SELECT id FROM chosen))
SELECT id, CASE WHEN corrupt THEN 'a selected run failed verification' END AS error,
  CASE WHEN NOT corrupt THEN 'sound' END AS payload FROM chosen CROSS JOIN stopped""",
)
def catalog_snapshot(spark, sf_dir):
    """The first runs by id; a corrupt one among them stops the export."""
    return _snapshot(spark, sf_dir, intact=False)


@query("catalog_snapshot_intact")
def catalog_snapshot_intact(spark, sf_dir):
    """Payloads of the first runs by id that are intact, with their series and final field."""
    return _snapshot(spark, sf_dir, intact=True)
