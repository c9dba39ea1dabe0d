"""Registered queries of look-up tables, pyramids, alignment, calibration, ghosts, neighbourhoods, composition, files and sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..operators import alignment, calibration, compose, deghost, levels, luts, merge, pixels, pyramids, stats, stencils
from ..sources import frames, pfs, text_files, views
from ..streaming import sequences
from . import render
from .registry import HSL_SQL, KEYS, LUM, PIX, RGB, WAVE, WX, WY, add, over_px, pct, r6, s6, srgb, three, triple


def lum(s, d) -> DataFrame:
    return stats.luminance(views.px(s, d))


def curve(spark, size: int, **columns: str) -> DataFrame:
    """(i, ...) for i below size, the columns SQL of i."""
    return spark.range(size).select(F.col("id").cast("int").alias("i")).select("i", *[F.expr(e).alias(c) for c, e in columns.items()])


# Look-up tables
add("lut_lookup", lambda s, d: r6(luts.bin_lookup(views.px(s, d).withColumn("m", F.least(F.col("g") / 120, F.lit(1.0))), "m", curve(s, color.BINS, bin="i", value="sqrt(i)")).select(*KEYS, "value"), "value"), f"select {PIX}, {s6('sqrt(floor(least(g/120e0, 1e0)*4095e0))', 'value')} from px")
add("lut_uniform", lambda s, d: r6(luts.interpolate_uniform(views.px(s, d), "g", curve(s, 41, y="cast(i * i as double)"), 0.0, 1.5, 41).select(*KEYS, "value"), "value"), f"q as (select {PIX}, greatest(0e0, least(g/1.5e0, 40e0)) as p from px), w as (select *, floor(p) as l from q) select {PIX}, {s6('l*l+case when l < 40 then ((l+1)*(l+1)-l*l)*(p-l) else 0e0 end', 'value')} from w")
TABLE = "lt as (select frame_id, i, i*i/10e0*(1+frame_id%3) as x, sqrt(i) as y from (select distinct frame_id from px) cross join (select unnest(range(31)) as i)), ls as (select *, lead(x) over (partition by frame_id order by i) as x1, lead(y) over (partition by frame_id order by i) as y1 from lt), le as (select frame_id, max(x) as xn from lt group by 1), lv as (select px.frame_id, px.x, px.y, greatest(0e0, least(g, xn)) as v from px join le using (frame_id))"


def frame_tables(s, d) -> DataFrame:
    return views.px(s, d).select("frame_id").distinct().crossJoin(curve(s, 31)).select("frame_id", (F.col("i") * F.col("i") / 10.0 * (1 + F.col("frame_id") % 3)).alias("lx"), F.sqrt("i").alias("ly"))


def by_frame_table(s, d) -> DataFrame:
    px = views.px(s, d).select("frame_id", F.col("x").alias("px"), F.col("y").alias("py"), "g")
    table = frame_tables(s, d).select("frame_id", F.col("lx").alias("x"), F.col("ly").alias("y"))
    return luts.interpolate(px, "g", table, "value", ["frame_id"], spread=F.sqrt).select("frame_id", F.col("px").alias("x"), F.col("py").alias("y"), "value")


add("lut_arbitrary", lambda s, d: r6(by_frame_table(s, d), "value"), f"{TABLE} select lv.frame_id, lv.x, lv.y, {s6('ls.y+coalesce((y1-ls.y)*(v-ls.x)/(x1-ls.x), 0e0)', 'value')} from lv join ls on lv.frame_id = ls.frame_id and v >= ls.x and (v < x1 or x1 is null)")
CURVE_SQL = f"""{LUM}, cv as (select i, i*i*0.002e0-2e0 as y from (select unnest(range(41)) as i)), cs as (select i, pow(10e0, y) as o, case when i = 40 then 1e0 else 2.48e0*pow(greatest((lead(y) over (order by i)-y)/0.1e0, 0e0), 0.82e0)/(1e0+1.48e0*pow(greatest((lead(y) over (order by i)-y)/0.1e0, 0e0), 0.82e0))*0.9e0 end as s from cv),
ct as (select *, lead(o) over (order by i) as o1, lead(s) over (order by i) as s1 from cs), cl as (select {PIX}, r, g, b, lum, greatest(0e0, least((log10(lum)+2e0)/0.1e0, 40e0)) as p from lm), cm as (select cl.*, o+coalesce((o1-o)*(p-i), 0e0) as lo, s+coalesce((s1-s)*(p-i), 0e0) as ss from cl join ct on i = floor(p))"""
over_px("tone_curve", lambda p: luts.apply_tone_curve(p, curve(p.sparkSession, 41, y="i * i * 0.002e0 - 2e0"), -2.0, 0.1, 41, 0.9), f"{CURVE_SQL} select {PIX}, {three('pow(greatest($/lum, 1e-8), ss)*lo')} from cm")

# Histograms, segments
add("histogram_256", lambda s, d: r6(stats.histogram_256(pixels.each(views.px(s, d), lambda c: F.floor(F.least(c * 2, F.lit(255.0)))), "g"), "share"), f"hq as (select frame_id, cast(floor(least(g*2e0, 255e0)) as int) as bin, count(*) as n from px group by 1, 2) select frame_id, bin, {s6('n/max(n) over (partition by frame_id)', 'share')} from hq")
for how, reject in (("reject", True), ("clamp", False)):
    outside = "and g >= 5 and g < 40" if reject else ""
    add(f"histogram_{how}", lambda s, d, reject=reject: stats.histogram(views.px(s, d), stats.floor_bin(F.col("g"), F.lit(5.0), F.lit(40.0), 30, reject)), f"select frame_id, cast(greatest(0, least(29, floor((g-5e0)/35e0*30e0))) as int) as bin, count(*) as n from px where true {outside} group by 1, 2")


def binned(name: str, src: str, c: str, shares: dict[str, float]) -> str:
    """SQL of percentiles of 1000 bins: `name` (frame_id and a column for each share in percent)."""
    at = lambda p, n: f"lo+(hi-lo)/1000e0*(case when floor({p!r}e0*total/100e0) <= min(case when bin = 0 then cum end) then 0.5e0 when max(cum) <= floor({p!r}e0*total/100e0) then 999.5e0 else arg_min(bin-0.5e0+(floor({p!r}e0*total/100e0)-cum+n)/n, bin) filter (cum > floor({p!r}e0*total/100e0)) end) as {n}"
    return f"""{name}s as (select frame_id, min({c}) as lo, max({c}) as hi, count(*) as total from {src} group by 1), {name}h as (select frame_id, lo, hi, total, coalesce(greatest(0, least(999, floor(({c}-lo)/(hi-lo)*1000e0))), 0) as bin, count(*) as n from {src} join {name}s using (frame_id) group by 1, 2, 3, 4, 5),
{name}c as (select *, sum(n) over (partition by frame_id order by bin) as cum from {name}h), {name} as (select frame_id, {", ".join(at(p, n) for n, p in shares.items())} from {name}c group by frame_id, lo, hi, total)"""


SHARES = {"a": 0.1, "m": 50.0, "z": 99.9}
add("binned_percentiles", lambda s, d: r6(stats.binned_percentiles(lum(s, d), "lum", SHARES), *SHARES), f"{LUM}, {binned('bp', 'lm', 'lum', SHARES)} select frame_id, {', '.join(s6(c, c) for c in SHARES)} from bp")
PLAN = f"{LUM}, lf as (select frame_id, min(lum) filter (lum > 0) as f from lm group by 1), l2 as (select lm.frame_id, lm.x, lm.y, log2(greatest(lum, f)) as lum from lm join lf using (frame_id)), {binned('bp', 'l2', 'lum', SHARES)}, pa as (select frame_id, a-4e0 as lo, z as hi, m, cast(ceil((z-(a-4e0))/8e0) as int) as segments from bp), pl as (select frame_id, segments, lo+(hi-lo-segments*8e0)/2e0 as start, m from pa)"
add("segment_plan", lambda s, d: r6(luts.segment_plan(views.px(s, d)), "start"), f"{PLAN} select frame_id, segments, {s6('start', 'start')}, round(m-start-4e0) as best from pl")
BASIS = {1: "i / 40e0", 2: "pow(i / 40e0, 2e0)"}


def basis_tables(spark) -> DataFrame:
    return text_files.basis_rows(curve(spark, 41, light="pow(2e0, i * 0.35e0 - 7e0)", y1=BASIS[1], y2=BASIS[2]).drop("i"), 2).drop("x")


def eased(c: str) -> str:
    p = f"greatest(0e0, least((log2({c})-start-8e0*segment+7e0)/0.35e0, 40e0))"
    at = lambda e: f"case when base = 1 then ({e})/40e0 else ({e})*({e})/1600e0 end"
    return f"65535e0*(({at(f'floor({p})')})+(({at(f'least(floor({p})+1, 40e0)')})-({at(f'floor({p})')}))*({p}-floor({p})))"


add("segment_values", lambda s, d: r6(luts.segment_values(views.px(s, d), luts.segment_plan(views.px(s, d)), basis_tables(s), -7.0, 0.35, 41, 2), *RGB), f"{PLAN}, sg as (select *, unnest(range(1, segments+2)) as segment from pl), sb as (select *, unnest(range(1, case when segment <= segments then 3 else 2 end)) as base from sg) select {PIX}, cast(segment as int) as segment, cast(base as int) as base, {', '.join(s6(eased(c), c) for c in RGB)} from px join sb using (frame_id)")
add("basis_table", lambda s, d: r6(text_files.basis_rows(views.px(s, d).groupBy((F.col("frame_id") % 41).alias("k")).agg(F.max("g").alias("light"), F.max("r").alias("y1"), F.max("b").alias("y2")).drop("k"), 2), "x", "y"), f"bt as (select max(g) as light, max(r) as y1, max(b) as y2 from px group by frame_id % 41), bo as (select *, row_number() over (order by light)-1 as i from bt) select cast(base as int) as base, cast(i as int) as i, {s6('log2(light)', 'x')}, {s6('case when base = 1 then y1 else y2 end', 'y')} from bo cross join (select unnest([1, 2]) as base)")

# Gradients, levels, contrast
EDGE = lambda w: f"coalesce((lead(g) over {w} - lag(g) over {w})/2e0, 0e0)"
add("gradients_border", lambda s, d: r6(pixels.gradients(views.px(s, d), "g", "border").select(*KEYS, "gx", "gy"), "gx", "gy"), f"select {PIX}, {s6(EDGE(WX), 'gx')}, {s6(EDGE(WY), 'gy')} from px")
add("gradients_clamped", lambda s, d: r6(pixels.gradients(views.px(s, d), "g", "clamped", 1).select(*KEYS, "gx", "gy"), "gx", "gy"), f"select {PIX}, {s6(f'(coalesce(lag(g) over {WX}, g)-coalesce(lead(g) over {WX}, g))/4e0', 'gx')}, {s6(f'(coalesce(lead(g) over {WY}, g)-coalesce(lag(g) over {WY}, g))/4e0', 'gy')} from px")
CEN = f"gc as (select {PIX}, {EDGE(WX)} as gx, {EDGE(WY)} as gy from px), gn as (select *, lag(gx) over {WX} as p, lead(gx) over {WX} as q, lag(gy) over {WY} as u, lead(gy) over {WY} as v from gc)"
add("divergence_central", lambda s, d: r6(pixels.divergence(pixels.gradients(views.px(s, d), "g", "border"), "central").select(*KEYS, "div"), "div"), f"{CEN} select {PIX}, {s6('(case when p is null then q-gx when q is null then gx-p else (q-p)/2e0 end)+(case when u is null then gy when v is null then gy-u else (v-u)/2e0 end)', 'div')} from gn")


def five(src: str, out: str, c: str, level: int, n: int) -> str:
    """SQL of the five-tap blur, a reflected look-up a tap."""
    ax = lambda a, size: ", ".join(f"case when abs(z.{a}+({j}))>={size} then 2*{size}-2-abs(z.{a}+({j})) else abs(z.{a}+({j})) end" for j in (-2 << level, -1 << level, 0, 1 << level, 2 << level))
    w = "[0.05e0, 0.25e0, 0.4e0, 0.25e0, 0.05e0]"
    sz = f"z{n} as (select *, max(x) over (partition by frame_id)+1 as w, max(y) over (partition by frame_id)+1 as h from {src})"
    a = f"a{n} as (select z.frame_id, z.x, z.y, z.h, unnest([{ax('x', 'z.w')}]) as t, unnest({w}) as k from z{n} z), b{n} as (select a.frame_id, a.x, a.y, a.h, sum(k*s.{c}) as v from a{n} a join {src} s on s.frame_id = a.frame_id and s.y = a.y and s.x = a.t group by 1, 2, 3, 4)"
    b = f"c{n} as (select z.frame_id, z.x, z.y, unnest([{ax('y', 'z.h')}]) as t, unnest({w}) as k from b{n} z), {out} as (select c.frame_id, c.x, c.y, sum(k*b.v) as {c} from c{n} c join b{n} b on b.frame_id = c.frame_id and b.x = c.x and b.y = c.t group by 1, 2, 3)"
    return f"{sz}, {a}, {b}"


add("blur_level", lambda s, d: r6(pixels.blur_level(views.px(s, d), "g", 1), "g"), f"{five('px', 'bl', 'g', 1, 1)} select {PIX}, {s6('g', 'g')} from bl")


def halved(src: str, out: str, n: int) -> str:
    w = lambda p, o: f"(partition by frame_id, {p} order by {o})"
    row, col = w("y", "x"), w("x", "y")
    return f"e{n} as (select {PIX}, (2e0*g+coalesce(lag(g) over {row}, g)+coalesce(lead(g) over {row}, g))/4e0 as g from {src}), f{n} as (select {PIX}, (2e0*g+coalesce(lag(g) over {col}, g)+coalesce(lead(g) over {col}, g))/4e0 as g from e{n}), h{n} as (select frame_id, floor((max(x)+1)/2)*2 as w, floor((max(y)+1)/2)*2 as h from {src} group by 1), {out} as (select frame_id, cast(floor(x/2) as int) as x, cast(floor(y/2) as int) as y, avg(g) as g from f{n} join h{n} using (frame_id) where x < w and y < h group by 1, 2, 3)"


PYR = f"{halved('px', 'p1', 1)}, {halved('p1', 'p2', 2)}, py as (select {PIX}, 0 as level, g from px union all select {PIX}, 1, g from p1 union all select {PIX}, 2, g from p2)"
add("pyramid", lambda s, d: r6(pyramids.pyramid(views.px(s, d), "g", 5), "g"), f"{PYR} select {PIX}, level, {s6('g', 'g')} from py")
STEEP = "ga as (select frame_id, level, x, y, sqrt(pow((coalesce(lag(g) over wx, g)-coalesce(lead(g) over wx, g))/pow(2e0, level+1), 2e0)+pow((coalesce(lead(g) over wy, g)-coalesce(lag(g) over wy, g))/pow(2e0, level+1), 2e0)) as grad from py window wx as (partition by frame_id, level, y order by x), wy as (partition by frame_id, level, x order by y)), gb as (select *, avg(grad) over (partition by frame_id, level) as mean from ga)"
add("gradient_attenuation", lambda s, d: r6(pyramids.gradient_attenuation(views.px(s, d), "g", 0.9, 0.85, 0.02, 5), "grad", "mean", "factor"), f"{PYR}, {STEEP} select {PIX}, level, {s6('grad', 'grad')}, {s6('mean', 'mean')}, {s6('pow((greatest(grad, 1e-4)+0.02e0)/(0.9e0*mean), -0.15e0)', 'factor')} from gb")


DENSITY = ", ".join(["l0 as (select frame_id, x, y, log10(g) as g from px)", *(five(f"l{k}", f"l{k + 1}", "g", k, 20 + k) for k in range(4))]) + f""", dd as ({' union all '.join(f'select frame_id, {k} as level, a.g-b.g as c, b.g as low from l{k} a join l{k + 1} b using (frame_id, x, y)' for k in range(4))}),
de as (select *, cast(floor((low+8e0)/0.1e0+0.5e0) as int) as light, cast(floor((c+0.7e0)/0.1e0+0.5e0) as int) as place from dd), dc as (select frame_id, level, light, case when c > 0.0043e0 and c < 0.05e0 then 8 when c < -0.0043e0 and c > -0.05e0 then 6 else place end as contrast, count(*) as n
from de where light between 0 and 160 and place between 0 and 14 group by all)"""
add("contrast_density", lambda s, d: pyramids.contrast_density(views.px(s, d), "g"), f"{DENSITY} select * from dc union all select frame_id, level, light, unnest([6, 8]), 1 from (select frame_id, level, light from dc group by 1, 2, 3 having count(*) filter (contrast <> 7) = 0) u")
CODE = lambda w: f"(list_aggregate(list_transform(range(0, 106), lambda i: case when {w} >= cw[i+1] and {w} < cw[i+2] then (i+({w}-cw[i+1])/(cw[i+2]-cw[i+1]))/106e0 else 0e0 end), 'sum') + case when {w} >= cw[107] then 1e0 else 0e0 end)"
WT = f"cw as (select [{', '.join(f'{w!r}e0' for w in pyramids.CONTRASTS)}] as cw)"
LOGS = f"lg as (select {PIX}, ln(g) as g from px), lx as (select {PIX}, coalesce(lead(g) over {WX} - g, 0e0) as gx from lg)"


def log_gradients(s, d) -> DataFrame:
    return pixels.gradients(views.px(s, d).withColumn("g", F.ln("g")), "g").select(*KEYS, "gx")


add("to_response", lambda s, d: r6(pyramids.to_response(log_gradients(s, d), "gx", 0.8), "gx"), f"{LOGS}, {WT}, lw as (select {PIX}, gx, exp(abs(gx)*0.8e0)-1e0 as w, cw from lx, cw) select {PIX}, {s6(f'case when gx < 0 then -1e0 else 1e0 end*{CODE("w")}', 'gx')} from lw")
add("from_response", lambda s, d: r6(pyramids.from_response(pyramids.to_response(log_gradients(s, d), "gx"), "gx").select(*KEYS, "gx"), "gx"), f"{LOGS} select {PIX}, {s6('case when exp(abs(gx))-1e0 > 10510.080619e0 then sign(gx)*ln(10511.080619e0) else gx end', 'gx')} from lx")
add("gradient_weight", lambda s, d: r6(log_gradients(s, d).select(*KEYS, pyramids.gradient_weight(F.col("gx")).alias("w")), "w"), f"{LOGS} select {PIX}, {s6('1e0/(0.038737e0*pow(greatest(0.001e0, abs(gx)), 0.537756e0))', 'w')} from lx")

# Composition, tags, panoramas
PARTS = {"r": "r", "b": "b", "alpha": "g"}


def mono(s, d, columns: dict[str, str]) -> dict[str, DataFrame]:
    px = views.px(s, d)
    return {name: px.where("x < 9" if name == "alpha" else "true").select(*KEYS, F.col(c).alias("value")) for name, c in columns.items()}


SPAN = "least(min(r), min(b), min(g) filter (x < 9)) as lo, greatest(max(r), max(b), max(g) filter (x < 9)) as hi"
add("compose_channels", lambda s, d: r6(compose.compose_channels(mono(s, d, PARTS), (1.0, 1.0, 0.9)), *RGB), f"z as (select frame_id, {SPAN} from px group by 1) select {PIX}, {s6('(r-lo)/(hi-lo)+case when x < 9 then (g-lo)/(hi-lo) else 0e0 end', 'r')}, {s6('0e0', 'g')}, {s6('(b-lo)/(hi-lo)*0.9e0', 'b')} from px join z using (frame_id)")
LIT = HSL_SQL.replace("select frame_id, x, y, r/60e0 as r, g/60e0 as g, b/60e0 as b from px", "select frame_id, x, y, (r-lo)/(hi-lo) as r, (g-lo)/(hi-lo) as g, (b-lo)/(hi-lo)*0.5e0 as b, (r*0.5e0+g*0.5e0-lo)/(hi-lo) as light from px join z using (frame_id)")


def lit_parts(s, d) -> dict[str, DataFrame]:
    px = views.px(s, d)
    return {c: px.select(*KEYS, F.col(c).alias("value")) for c in RGB} | {"lum": px.select(*KEYS, (F.col("r") * 0.5 + F.col("g") * 0.5).alias("value"))}


add("compose_with_lightness", lambda s, d: r6(compose.compose_channels(lit_parts(s, d), (1.0, 1.0, 0.5)), *RGB), f"z as (select frame_id, min(least(r,g,b)) as lo, max(greatest(r,g,b)) as hi from px group by 1), {LIT}, h4 as (select {PIX}, h, s, light as l from h3) select {PIX}, {triple([WAVE('0e0'), WAVE('4e0'), WAVE('2e0')])} from h4")


def tagged(s, d, kind: str) -> DataFrame:
    """Files of a folder with tags; the targets are every other file under another name."""
    m = views.meta(s, d)
    text = lambda c: F.round(F.coalesce(F.col(c), F.lit(-1.0)) * 1000).cast("bigint").cast("string")
    if kind == "src":
        return m.select("folder_id", "file", F.create_map(F.lit("Exif.Photo.FNumber"), text("f_number"), F.lit("Exif.Photo.ISOSpeedRatings"), text("iso"), F.lit("Exif.GPSInfo.Altitude"), F.col("orientation").cast("string"), F.lit("Exif.Thumbnail.Size"), F.lit("9"), F.lit("Exif.Photo.MakerNote"), F.lit("x")).alias("tags"))
    return m.where("file_id % 2 = 0").select("folder_id", F.concat("file", F.lit(".out")).alias("file"), F.create_map(F.lit("Exif.Photo.FNumber"), F.lit("own"), F.lit("Exif.Image.Orientation"), F.col("orientation").cast("string")).alias("tags"))


def flat(df: DataFrame) -> DataFrame:
    return df.select("folder_id", "file", F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("tags"))


MADE = {
    "keep": "'Exif.GPSInfo.Altitude=' || o || ';Exif.Image.Orientation=1;Exif.Photo.FNumber=own;Exif.Photo.ISOSpeedRatings=' || i",
    "replace": """'Exif.GPSInfo.Altitude=' || o || ';Exif.Image.ImageDescription=hi;Exif.Image.Orientation=1;Exif.Image.ProcessingSoftware=framelake;Exif.Image.Software=framelake;Exif.Photo.FNumber=' || f || ';Exif.Photo.ISOSpeedRatings=' || i || ';Exif.Photo.UserComment=charset="Ascii" hi'""",
    "verbatim": "'Exif.GPSInfo.Altitude=' || o || ';Exif.Photo.FNumber=' || f || ';Exif.Photo.ISOSpeedRatings=' || i || ';Exif.Photo.MakerNote=x;Exif.Thumbnail.Size=9'",
}
for mode in MADE:
    add(f"transplant_tags_{mode}", lambda s, d, mode=mode: flat(compose.transplant_tags(tagged(s, d, "src"), tagged(s, d, "dst"), mode, "hi")), f"sr as (select folder_id, row_number() over (partition by folder_id order by file) as i_, cast(orientation as varchar) as o, cast(cast(round(coalesce(f_number, -1e0)*1000) as bigint) as varchar) as f, cast(cast(round(coalesce(iso, -1e0)*1000) as bigint) as varchar) as i from meta), ds as (select folder_id, file || '.out' as file, row_number() over (partition by folder_id order by file) as i_ from meta where file_id % 2 = 0) select folder_id, file, {MADE[mode]} as tags from ds join sr using (folder_id, i_)")
add("project_polar_to_angular", lambda s, d: r6(compose.project(views.px(s, d), "polar", "angular", 16, (10.0, 20.0, 30.0), 2), *RGB))
add("project_mirrorball_to_cylindrical", lambda s, d: r6(compose.project(views.px(s, d), "mirrorball", "cylindrical", 24, interpolate=False), *RGB))

# G: alignment, calibration, ghosts
add("mtb_align", lambda s, d: alignment.mtb_align(views.stack(s, d)), """gy as (select scene_id, exposure_idx as e, x, y, cast(floor(greatest(0e0, least(1e0, 0.2126729e0*r+0.7151522e0*g+0.072175e0*b))*255e0+0.5e0) as int) as l from stack), gh as (select scene_id, e, l, count(*) as n from gy group by 1, 2, 3),
gt as (select scene_id, e, min(l) as t from (select *, sum(n) over (partition by scene_id, e order by l) as c, sum(n) over (partition by scene_id, e) as a from gh) where c >= floor(a*0.5e0) group by 1, 2), gb as (select scene_id, e, x, y, l >= t as bit from gy join gt using (scene_id, e) where abs(l-t) >= 4),
gs as (select scene_id, e, i, j from (select distinct scene_id, exposure_idx as e from stack where exposure_idx > 0) cross join (select unnest([-1, 0, 1]) as i) cross join (select unnest([-1, 0, 1]) as j)),
ge as (select b.scene_id, b.e, i, j, count(*) filter (b.bit <> a.bit) as err from gb b join gs s on b.scene_id = s.scene_id and b.e = s.e join gb a on a.scene_id = b.scene_id and a.e = b.e-1 and a.x = b.x-i and a.y = b.y-j group by 1, 2, 3, 4),
gr as (select scene_id, e, i, j, row_number() over (partition by scene_id, e order by coalesce(err, 0), i, j) as rn from gs left join ge using (scene_id, e, i, j)), gm as (select scene_id, e, i, j from gr where rn = 1 union all select distinct scene_id, 0, 0, 0 from stack)
select scene_id, cast(e as int) as exposure_idx, cast(sum(i) over (partition by scene_id order by e) as int) as dx, cast(sum(j) over (partition by scene_id order by e) as int) as dy from gm""")
SMALL = 4
OFF = lambda c: f"case when s.{c} > 0 and o.{c} > 0 then abs(ln(s.{c})-ln(o.{c})-sign(s.ev-o.ev)*ln(abs(s.ev-o.ev))) > 2e0*dev_{c} else s.{c} > 0 or o.{c} > 0 end"
DEV = lambda c: f"case when greatest(s.r,s.g,s.b,o.r,o.g,o.b) < 1 and least(s.r,s.g,s.b,o.r,o.g,o.b) > 0 then abs(ln(s.{c})-ln(o.{c})-sign(s.ev-o.ev)*ln(abs(s.ev-o.ev))) else 0e0 end"
GHOST = f"""pd as (select scene_id, s.exposure_idx, {', '.join(f'avg({DEV(c)})+stddev_pop({DEV(c)}) as dev_{c}' for c in RGB)} from stack s join stack o using (scene_id, x, y) where o.exposure_idx = 1 and s.exposure_idx <> 1 group by 1, 2), pz as (select scene_id, floor((max(x)+1)/{SMALL}) as wide, floor((max(y)+1)/{SMALL}) as high from stack group by 1),
pf as (select scene_id, s.exposure_idx, cast(floor(x/wide) as int) as px, cast(floor(y/high) as int) as py, wide*high as area, ({') or ('.join(OFF(c) for c in RGB)}) as far from stack s join stack o using (scene_id, x, y) join pd on pd.scene_id = s.scene_id and pd.exposure_idx = s.exposure_idx join pz using (scene_id) where o.exposure_idx = 1 and s.exposure_idx <> 1 and s.ev <> o.ev),
ps as (select scene_id, exposure_idx, px, py, count(*) filter (far)/area as share from pf where px < {SMALL} and py < {SMALL} group by scene_id, exposure_idx, px, py, area), gp as (select scene_id, px, py, max(share) > 0.2e0 as ghost from ps group by 1, 2, 3)"""


def patches(s, d) -> DataFrame:
    return deghost.ghost_patches(views.stack(s, d), 1, 0.2, SMALL)


add("ghost_patches", patches, f"{GHOST} select scene_id, px, py, ghost from gp")
add("ghost_percent", lambda s, d: r6(deghost.ghost_percent(patches(s, d), SMALL), "percent"), f"{GHOST} select scene_id, {s6(f'count(*) filter (ghost)*100e0/{SMALL * SMALL}', 'percent')} from gp group by 1")
GRADS = "ql as (select scene_id as frame_id, exposure_idx, x, y, g from stack), qg as (select frame_id, exposure_idx, x, y, coalesce((lead(g) over wx - lag(g) over wx)/2e0, 0e0) as gx, coalesce((lead(g) over wy - lag(g) over wy)/2e0, 0e0) as gy from ql window wx as (partition by frame_id, exposure_idx, y order by x), wy as (partition by frame_id, exposure_idx, x order by y))"
BOTH = f"qb as (select a.frame_id, a.x, a.y, a.gx, a.gy, o.gx as hx, o.gy as hy from qg a join qg o using (frame_id, x, y) where a.exposure_idx = 2 and o.exposure_idx = 1), qn as (select *, {', '.join(f'lag(g{c}) over wy as up{c}, lead(h{c}) over wy as dn{c}, lag(g{c}) over wx as lf{c}, lead(h{c}) over wx as rt{c}' for c in 'xy')} from qb window wx as (partition by frame_id, y order by x), wy as (partition by frame_id, x order by y))"


def exposure_gradients(s, d, exposure: int) -> DataFrame:
    one = views.stack(s, d).where(F.col("exposure_idx") == exposure).select(F.col("scene_id").alias("frame_id"), "x", "y", "g")
    return pixels.gradients(one, "g", "border")


MIX = lambda c: f"case when coalesce(ghost, false) and dnx is not null then (case when y % high = 0 and lf{c} is not null and rt{c} is not null then (rt{c}+lf{c})/2e0 when x % wide = 0 and up{c} is not null then (dn{c}+up{c})/2e0 else h{c} end) else g{c} end"
add("blend_gradients", lambda s, d: r6(deghost.blend_gradients(exposure_gradients(s, d, 2), exposure_gradients(s, d, 1), patches(s, d).withColumnRenamed("scene_id", "frame_id"), SMALL), "gx", "gy"), f"{GHOST}, {GRADS}, {BOTH} select qn.frame_id, x, y, {s6(MIX('x'), 'gx')}, {s6(MIX('y'), 'gy')} from qn join pz on pz.scene_id = qn.frame_id left join gp on gp.scene_id = qn.frame_id and gp.px = floor(x/wide) and gp.py = floor(y/high)")
add("select_gradients", lambda s, d: r6(deghost.select_gradients(exposure_gradients(s, d, 2), exposure_gradients(s, d, 1), views.px(s, d).where("r > b")), "gx", "gy"), f"""qr as (select frame_id, x, y, r as pr, b as pb, t.exposure_idx, least(1e0, g/60e0*pow(2e0, t.ev)) as v from px cross join (select 1 as exposure_idx, 0e0 as ev union all select 2, 2e0) t), qs as (select *, cast(floor(v*255e0+5e-1) as double)/255e0 as g from qr),
qg as (select *, coalesce((lead(g) over wx - lag(g) over wx)/2e0, 0e0) as gx, coalesce((lead(g) over wy - lag(g) over wy)/2e0, 0e0) as gy from qs window wx as (partition by frame_id, exposure_idx, y order by x), wy as (partition by frame_id, exposure_idx, x order by y))
select frame_id, x, y, {s6('case when max(pr) > max(pb) then max(gx) filter (exposure_idx = 1) else max(gx) filter (exposure_idx = 2) end', 'gx')}, {s6('case when max(pr) > max(pb) then max(gy) filter (exposure_idx = 1) else max(gy) filter (exposure_idx = 2) end', 'gy')} from qg group by 1, 2, 3""")
Q = lambda c: f"(floor({c}*4095e0)/4095e0)"
KINDS = {
    "triangular": lambda c: f"(case when {Q(c)} < {2 / 4096!r}e0 or {Q(c)} > 1e0-{2 / 4096!r}e0 then 0e0 when {Q(c)} < 0.5e0 then 2e0*{Q(c)} else 2e0*(1e0-{Q(c)}) end)",
    "gaussian": lambda c: f"(case when {Q(c)} < {2 / 4096!r}e0 or {Q(c)} > 1e0-{2 / 4096!r}e0 then 0e0 else exp(-32e0*({Q(c)}-0.5e0)*({Q(c)}-0.5e0)) end)",
    "plateau": lambda c: f"(case when {Q(c)} < 0.00025e0 or {Q(c)} > 0.99975e0 then 0e0 else 1e0-pow(2e0*{Q(c)}-1e0, 12e0) end)",
}
STEP = lambda c: f"(greatest(floor({c}*4095e0), 1e0)/4095e0)"
ANSWER = {"linear": STEP, "gamma": lambda c: f"(pow(4e0*{STEP(c)}, 1.7e0)+1e-4)"}


def debevec(src: str, weight: str, response: str, out: str) -> str:
    """SQL of a merge of `src` (scene_id, x, y, exposure_idx, ev, r, g, b); the darker exposure is the last of the strictly darker ones."""
    w, top = KINDS[weight], ANSWER[response]("1e0")
    a = ANSWER[response]
    mean = f"({w('r')}+{w('g')}+{w('b')})/3e0"
    kept = ", ".join(f"1e0-pow(pow(2e0, ev-dev)*{a('d' + c)}/{top}, 4e0)" for c in RGB)
    return f"""{out}d as (select a.*, d.ev as dev, d.r as dr, d.g as dg, d.b as db, row_number() over (partition by a.scene_id, a.x, a.y, a.exposure_idx order by d.ev desc, d.exposure_idx desc) as rk from {src} a left join {src} d on a.scene_id = d.scene_id and a.x = d.x and a.y = d.y and d.ev < a.ev),
{out}w as (select *, case when dr is null then greatest({mean}, 1e-6) else {mean}*greatest(0e0, least(1e0, {kept})) end as w from {out}d where rk = 1), {out} as (select scene_id, x, y, {', '.join(f'exp(sum(w*(ln({a(c)})-ev*ln(2e0)))/sum(w)) as {c}' for c in RGB)} from {out}w group by 1, 2, 3)"""


TIED = "st as (select * replace (least(ev, 0e0) as ev) from stack)"
add("merge_ties", lambda s, d: r6(merge.merge_debevec(views.stack(s, d).withColumn("ev", F.least("ev", F.lit(0.0)))), *RGB), f"{TIED}, {debevec('st', 'triangular', 'linear', 'md')} select scene_id, x, y, {three('$')} from md")
for name, (_, weight, response) in merge.PROFILES.items():
    add(f"merge_{name}", lambda s, d, name=name: r6(merge.merge(views.stack(s, d), name), *RGB), f"{debevec('stack', weight, response, 'md')} select scene_id, x, y, {three('$')} from md")


def squares(spark) -> DataFrame:
    """A custom response: the square of the gamma-free sample, by channel and bin."""
    bins = curve(spark, color.BINS, bin="i", value="pow(greatest(i, 1) / 4095e0, 2e0)").drop("i")
    return bins.crossJoin(spark.sql("select explode(array('r', 'g', 'b')) as channel"))


ANSWER["square"] = lambda c: f"pow({STEP(c)}, 2e0)"
add("merge_custom_response", lambda s, d: r6(merge.merge_debevec(views.stack(s, d), "gaussian", squares(s)), *RGB), f"{debevec('stack', 'gaussian', 'square', 'md')} select scene_id, x, y, {three('$')} from md")
add("merge_deghosted", lambda s, d: r6(deghost.merge_deghosted(views.stack(s, d), patches(s, d), 1, SMALL), *RGB), f"{GHOST}, sk as (select s.* from stack s join pz using (scene_id) left join gp on gp.scene_id = s.scene_id and gp.px = floor(s.x/wide) and gp.py = floor(s.y/high) where s.exposure_idx = 1 or not coalesce(ghost, false)), {debevec('sk', 'triangular', 'linear', 'md')}, mz as (select scene_id, min(least(r,g,b)) as lo, max(greatest(r,g,b)) as hi from md group by 1) select scene_id, x, y, {three('($-lo)/(hi-lo)')} from md join mz using (scene_id)")


def one_turn(s, d) -> DataFrame:
    samples = calibration.samples_of(views.stack(s, d), "triangular")
    return calibration.calibrate_turn(samples, "linear")


TRI = KINDS["triangular"]
TURN = f"""ch as (select scene_id, x, y, exposure_idx, ev, 'r' as channel, r as v from stack union all select scene_id, x, y, exposure_idx, ev, 'g', g from stack union all select scene_id, x, y, exposure_idx, ev, 'b', b from stack),
ca as (select a.*, d.ev as dev, d.v as dv from ch a left join ch d on a.scene_id = d.scene_id and a.channel = d.channel and a.x = d.x and a.y = d.y and d.exposure_idx = a.exposure_idx-1), cb as (select *, greatest(floor(v*4095e0), 1e0)/2047e0 as res, case when dv is null then greatest({TRI('v')}, 1e-6) else {TRI('v')}*greatest(0e0, 1e0-pow(pow(2e0, ev-dev)*{STEP('dv')}, 4e0)) end as w from ca),
cc as (select scene_id, channel, v, pow(2e0, ev) as t, sum(w*res) over p as sr, sum(w*pow(2e0, ev)) over p as sd from cb window p as (partition by scene_id, channel, x, y)), cd as (select scene_id, channel, cast(floor(v*4095e0) as int) as bin, avg(t*case when sd <> 0 then sr/sd else 0e0 end) as m from cc group by 1, 2, 3),
ce as (select scene_id, channel, cast(bin as int) as bin from (select distinct scene_id, channel from ch) cross join (select unnest(range(4096)) as bin)), cf as (select scene_id, channel, bin, coalesce(last_value(m ignore nulls) over (partition by scene_id, channel order by bin), 0e0) as v from ce left join cd using (scene_id, channel, bin)),
cg as (select scene_id, channel, min(bin)+floor((max(bin)-min(bin))/2) as mid from cf where v <> 0 group by 1, 2), ci as (select scene_id, channel, arg_min(v, bin) as u from cf join cg using (scene_id, channel) where bin >= mid and v <> 0 group by 1, 2)"""
add("calibrate_response", lambda s, d: r6(calibration.calibrate_response(views.stack(s, d)), "value"))
add("calibrate_turn", lambda s, d: r6(one_turn(s, d), "value"), f"{TURN} select scene_id, channel, bin, {s6('v/coalesce(u, 1e0)', 'value')} from cf left join ci using (scene_id, channel)")

# Neighbourhoods and receptors
NEAR = f"{LUM}, ol as (select unnest(range(-4, 5)) as dy), oc as (select unnest(range(-4, 5)) as dx), od as (select dx, dy from ol cross join oc where dx*dx+dy*dy <= 16), oa as (select c.frame_id, c.x, c.y, c.lum, exp(-pow(ln(n.lum)/ln(5e0)-ln(c.lum)/ln(5e0), 6e0)) as w, n.lum as l from lm c cross join od join lm n on n.frame_id = c.frame_id and n.x = c.x+dx and n.y = c.y+dy where n.x > 0 and n.y > 0), ob as (select frame_id, x, y, sum(w*l)/sum(w) as v from oa group by 1, 2, 3)"
add("local_adaptation", lambda s, d: r6(stencils.local_adaptation(views.px(s, d)), "value"), f"{NEAR} select {PIX}, {s6('coalesce(v, lum)', 'value')} from lm left join ob using (frame_id, x, y)")
GAUSS = "(case when abs(n.i-c.i) <= sqrt(-ln(0.01e0)*0.32e0) then exp(-pow(floor(abs(n.i-c.i)*255e0/sqrt(-ln(0.01e0)*0.32e0))/255e0*sqrt(-ln(0.01e0)*0.32e0), 2e0)/0.32e0) else 0e0 end)"
LIGHTS = "il as (select *, (20e0*r+40e0*g+b)/61e0 as i0 from px), im as (select frame_id, min(i0) filter (i0 > 0) as m from il group by 1), ii as (select il.*, greatest(i0, m) as it, ln(greatest(i0, m)) as i from il join im using (frame_id))"
BASE = f"{LIGHTS}, ik as (select c.frame_id, c.x, c.y, sum(n.i*exp(-((n.x-c.x)*(n.x-c.x)+(n.y-c.y)*(n.y-c.y))/2e0)*{GAUSS})/sum(exp(-((n.x-c.x)*(n.x-c.x)+(n.y-c.y)*(n.y-c.y))/2e0)*{GAUSS}) as v from ii c join ii n on n.frame_id = c.frame_id and n.x between c.x-2 and c.x+1 and n.y between c.y-2 and c.y+1 group by 1, 2, 3)"


def log_intensity(s, d) -> DataFrame:
    return views.px(s, d).select(*KEYS, F.ln((20.0 * F.col("r") + 40.0 * F.col("g") + F.col("b")) / 61.0).alias("i"))


add("bilateral", lambda s, d: r6(stencils.bilateral(log_intensity(s, d), "i", 1.0, 0.4), "value"), f"{BASE} select {PIX}, {s6('v', 'value')} from ik")
DURAND = f"""{pct('dq', 'ik', 'v', 'frame_id', 0.01, 0.99)}, ds as (select *, 2.48e0*pow(k, 0.82e0)/(1e0+1.48e0*pow(k, 0.82e0)) as s from (select frame_id, q_lo, 2e0/(q_hi-q_lo) as k from dq) u), dl as (select px.*, (20e0*r+40e0*g+b)/61e0 as li, v, k, s, q_lo from px join ik using (frame_id, x, y) join ds using (frame_id)),
dm as (select {PIX}, {', '.join(f'exp(s*ln({c}/li)+v*(k-1e0)+ln(li)-(4.3e0+q_lo*k)) as {c}' for c in RGB)} from dl) select {PIX}, {triple([srgb(c) for c in RGB])} from dm"""
over_px("tm_durand", lambda p: stencils.tm_durand(p, 1.0, 0.4, 2.0), f"{BASE}, {DURAND}")
# The grid with cells of 6 pixels and half of 0.4: cells, three blurs, and the eight cells around a pixel.
TAP = lambda n: f"(select d, exp(-d*d/7.5e0) as w from (select unnest(range(-{n}, {n + 1})) as d) u)"
GRID = f"""ii as (select {PIX}, ln((20e0*r+40e0*g+b)/61e0) as i from px), c0 as (select frame_id, cast(floor(x/6e0+0.5e0) as int) as cx, cast(floor(y/6e0+0.5e0) as int) as cy, cast(floor(i/{0.4 / 2!r}e0+0.5e0) as int) as cz, cast(count(*) as double) as n, sum(i) as v from ii group by all),
c1 as (select frame_id, cx, cy, cz+d as cz, sum(n*w) as n, sum(v*w) as v from c0 cross join {TAP(7)} t group by 1, 2, 3, 4), c2 as (select frame_id, cx+d as cx, cy, cz, sum(n*w) as n, sum(v*w) as v from c1 cross join {TAP(4)} t where cx+d >= 0 group by 1, 2, 3, 4),
c3 as (select frame_id, cx, cy+d as cy, cz, sum(n*w) as n, sum(v*w) as v from c2 cross join {TAP(4)} t where cy+d >= 0 group by 1, 2, 3, 4), c4 as (select {PIX}, cast(floor(x/6e0) as int) as fx, cast(floor(y/6e0) as int) as fy, cast(floor(i/{0.4 / 2!r}e0) as int) as fz, x/6e0 as ux, y/6e0 as uy, i/{0.4 / 2!r}e0 as uz from ii),
ik as (select c4.frame_id, x, y, sum(v*(1e0-abs(ux-cx))*(1e0-abs(uy-cy))*(1e0-abs(uz-cz)))/sum(n*(1e0-abs(ux-cx))*(1e0-abs(uy-cy))*(1e0-abs(uz-cz))) as v from c4 cross join (select unnest([0, 1]) as a) ka cross join (select unnest([0, 1]) as b) kb cross join (select unnest([0, 1]) as c) kc
join c3 on c3.frame_id = c4.frame_id and cx = fx+a and cy = fy+b and cz = fz+c group by 1, 2, 3)"""
add("bilateral_grid", lambda s, d: r6(stencils.bilateral_grid(log_intensity(s, d), "i", 12.0, 0.4, 2), "value"), f"{GRID} select {PIX}, {s6('v', 'value')} from ik")
over_px("tm_durand_wide", lambda p: stencils.tm_durand(p, 12.0, 0.4, 2.0, 2), f"{GRID}, {DURAND}")
SOLVE = lambda drive: f"list_reduce(list_prepend(sqrt(sqrt({drive})), [1e0, 2e0, 3e0, 4e0, 5e0, 6e0, 7e0, 8e0]), lambda x, k: x-(0.09e0*x*x*x*x*x+x*x*x*x-({drive}))/(0.45e0*x*x*x*x+4e0*x*x*x))"
over_px("tm_vanhateren", stencils.tm_vanhateren, f"vg as (select {PIX}, {', '.join(f'pow({c}, {1 / 1.8!r}e0) as {c}' for c in RGB)} from px), vl as (select *, 0.2126729e0*g+0.7151522e0*r+0.072175e0*b as lum from vg), vd as (select *, 1e0/(2.8e-3+1.6e-4*lum*10e0) as dv from vl) select {PIX}, {three(f'$*(1e0-{SOLVE("dv")}/{SOLVE("1e0/2.8e-3")})/lum')} from vd")

# rendering
def render_presets(s, d) -> DataFrame:
    """Four presets, two of which begin alike and one of which cannot be planned."""
    made, errors = render.render_batch(views.px(s, d), {"a": {"tmo": "drago", "bits": 16}, "b": {"tmo": "reinhard02", "postgamma": 1.5}, "c": {"tmo": "none"}, "d": {"tmo": "drago", "postgamma": 2.0}})
    assert [(r["preset"], r["frame_id"]) for r in errors.collect()] == [("c", None)]
    return made



# files
def bins_of(s, d) -> DataFrame:
    st = views.stack(s, d)
    return st.select("scene_id", F.floor(F.col("g") * 4095.0).cast("int").alias("m")).distinct()


def curve_text(s, d) -> DataFrame:
    """Response files of the bins that a scene holds, with their headers."""
    rows = bins_of(s, d).select("scene_id", "m", (F.col("m") / 4095.0).alias("r"), (F.col("m") / 2048.0).alias("g"), (F.col("m") * 2.0).alias("b"))
    own = Window.partitionBy("scene_id")  # a file's rows; its header comes with the first
    rows = text_files.response_text(rows, "scene_id").withColumns({"i": F.row_number().over(own.orderBy("m")), "n": F.count("*").over(own)})
    head = F.array(F.lit("# Camera response"), F.concat(F.lit("# rows: "), F.col("n").cast("string")), F.lit("# columns: 7"), F.col("line"))
    return rows.select(F.concat(F.lit("s"), F.col("scene_id").cast("string")).alias("file"), F.explode(F.when(F.col("i") == 1, head).otherwise(F.array("line"))).alias("value"))


MS = "ms as (select distinct scene_id, cast(floor(g*4095e0) as int) as m from stack)"
LG = lambda e: f"case when m = 0 then -6e0 else round(log10({e}), 6) end"
add("response_file", lambda s, d: r6(text_files.parse_response(curve_text(s, d)), "m", "log_r", "r", "log_g", "g", "log_b", "b"), f"{MS} select 's' || scene_id as file, {s6('cast(m as double)', 'm')}, {', '.join(s6(LG(e), f'log_{c}') + ', ' + s6(f'round({e}, 6)', c) for c, e in (('r', 'm/4095e0'), ('g', 'm/2048e0'), ('b', 'm*2e0')))} from ms")
add("weights_file", lambda s, d: text_files.weights_text(bins_of(s, d).select("m").distinct().select(F.col("m").alias("level"), (F.col("m") / 4095.0).alias("weight"))), f"{MS} select distinct m as level, printf(' %15.9f %4d', m/4095e0, m) as line from ms")


def setting_lines(s, d) -> DataFrame:
    m = views.meta(s, d)
    line = lambda i, e: F.struct(F.lit(i).alias("i"), e.alias("value"))
    tmo = F.when(F.col("orientation") == 1, "Durand02").when(F.col("orientation") == 3, "Reinhard02").otherwise("Fattal02")
    lines = [line(0, F.lit("# saved settings")), line(1, F.lit("VERSION=0.6")), line(2, F.concat(F.lit("TMO="), tmo)), line(3, F.lit("RANGE=1")), line(4, F.concat(F.lit("RANGE="), (F.col("file_id") % 9).cast("string"), F.lit(" # stops"))), line(5, F.lit("AUTOLUM = NO")), line(6, F.lit("KEY=a=b"))]
    return m.select("file", F.explode(F.array(*lines)).alias("l")).select("file", "l.i", "l.value")


def settings(s, d) -> DataFrame:
    t = text_files.parse_settings(setting_lines(s, d))
    name = F.map_keys("numbers")[0]
    return t.select("file", "version", "tmo", name.alias("range_key"), F.col("numbers")[name].alias("range"), F.col("switches")["autolum"].alias("autolum"), F.col("texts")["key"].alias("key"))


add("settings_file", settings, "select file, '0.6' as version, case orientation when 1 then 'Durand02' when 3 then 'Reinhard02' else 'Fattal02' end as tmo, case orientation when 1 then 'durand_range' when 3 then 'reinhard_range' else 'range' end as range_key, cast(file_id % 9 as double) as range, false as autolum, 'a=b' as key from meta")


def container_rows(s, d) -> DataFrame:
    packed = pfs.to_pfs_bytes(views.px(s, d)).select(F.col("frame_id").cast("string").alias("path"), "content")
    return pfs.pixels_of(packed).select(F.col("path").cast("bigint").alias("frame_id"), "x", "y", *RGB)


F32 = ", ".join(s6(f"cast(cast({c} as float) as double)", c) for c in RGB)
add("container", lambda s, d: r6(container_rows(s, d), *RGB), f"select {PIX}, {F32} from px")


def stored(s, d, kind: str = "orc") -> DataFrame:
    path = f"{frames.shared_folder(s)}/frames-{uuid.uuid4().hex}.{kind}"
    frames.write_pixels(views.px(s, d).select(*KEYS, *RGB), path)
    return frames.read_pixels(s, path)


add("stored_containers", lambda s, d: r6(stored(s, d, "pfs"), *RGB), f"select {PIX}, {F32} from px")
add("stored_frames", lambda s, d: r6(stored(s, d), *RGB), f"select {PIX}, {three('$')} from px")

# J: sequences
STATES = sequences.STATES
ADAPT = """ad as materialized (with recursive f as (select seq_id, n, 60e0*exp(-0.04e0/0.08e0)+(1e0-exp(-0.04e0/0.08e0))*lum as c, 60e0*exp(-0.04e0/0.15e0)+(1e0-exp(-0.04e0/0.15e0))*lum as r, 2e6/2000060e0*(1e0-0.04e0/110e0-0.04e0*lum/2.2e8)+0.04e0/110e0 as p, 0.04e0/60.04e0*(1e0-0.04e0/400e0-0.04e0*lum/16e0)+0.04e0/400e0 as q from seq where n = 1
union all select s.seq_id, s.n, f.c*exp(-0.04e0/0.08e0)+(1e0-exp(-0.04e0/0.08e0))*s.lum, f.r*exp(-0.04e0/0.15e0)+(1e0-exp(-0.04e0/0.15e0))*s.lum, f.p*(1e0-0.04e0/110e0-0.04e0*s.lum/2.2e8)+0.04e0/110e0, f.q*(1e0-0.04e0/400e0-0.04e0*s.lum/16e0)+0.04e0/400e0 from f join seq s on s.seq_id = f.seq_id and s.n = f.n+1) select * from f)"""
add("temporal_adaptation", lambda s, d: r6(sequences.temporal_adaptation(views.seq(s, d), chunk=16), *STATES), f"{ADAPT} select seq_id, n, {', '.join(s6(a, b) for a, b in zip('crpq', STATES, strict=True))} from ad")


def curve_points(s, d) -> DataFrame:
    """Four points of a tone curve a frame; a black frame is at minus infinity, which log10 of Spark leaves null."""
    log = F.when(F.col("lum") == 0, float("-inf")).otherwise(F.log10("lum"))
    return views.seq(s, d).select("seq_id", "n", F.posexplode(F.array(*[log * k / 4.0 for k in (1, 2, 3, 4)])).alias("point", "y"))


PAST, NOW = sequences.FILTERS[25]
TAP = lambda x, y: " + ".join(f"{b!r}e0*{e}" for b, e in zip(NOW, x, strict=True)) + "".join(f" - ({a!r}e0)*{e}" for a, e in zip(PAST, y, strict=True))
OLD = "(case least(f.k, 3) when 1 then f.x1 when 2 then f.x2 when 3 then f.x3 end)"
IN = ["p.y", *(f"(case when f.k >= {t} then f.x{t} else {OLD} end)" for t in (1, 2, 3))]
OUT = [f"(case when f.k >= {t} then f.y{t} else {IN[t]} end)" for t in (1, 2, 3)]
FIRST = TAP(["p.y"] * 4, ["p.y"] * 3)
FILTER = f"""cp as (select seq_id, n, cast(k-1 as int) as point, log10(lum)*k/4e0 as y from seq cross join (select unnest([1, 2, 3, 4]) as k)), tf as materialized (with recursive f as (select seq_id, n, point, 1 as k, y as x1, 0e0 as x2, 0e0 as x3, {FIRST} as y1, 0e0 as y2, 0e0 as y3 from cp p where n = 1
union all select p.seq_id, p.n, p.point, least(f.k+1, 4), p.y, f.x1, f.x2, {TAP(IN, OUT)}, f.y1, f.y2 from f join cp p on p.seq_id = f.seq_id and p.point = f.point and p.n = f.n+1) select * from f)"""
add("filter_tone_curves", lambda s, d: r6(sequences.filter_tone_curves(curve_points(s, d), 25, -0.5, 1.5), "y"), f"{FILTER} select seq_id, n, point, {s6('least(greatest(y1, -0.5e0), 1.5e0)', 'y')} from tf")
add("frame_stats", lambda s, d: r6(sequences.frame_stats(views.seq(s, d)), "lo", "hi", "mean"), f"select date_trunc('hour', ts) as start, count(*) as frames, {s6('min(lum)', 'lo')}, {s6('max(lum)', 'hi')}, {s6('avg(lum)', 'mean')} from seq group by 1")
add("frame_sessions", lambda s, d: r6(sequences.frame_stats(views.seq(s, d), gap="6 hours"), "lo", "hi", "mean"), f"ta as (select *, case when ts - lag(ts) over (partition by seq_id order by ts) < interval 6 hours then 0 else 1 end as new from seq), tb as (select *, sum(new) over (partition by seq_id order by ts) as k from ta) select seq_id, min(ts) as start, count(*) as frames, {s6('min(lum)', 'lo')}, {s6('max(lum)', 'hi')}, {s6('avg(lum)', 'mean')} from tb group by seq_id, k")


# The same with two coarser levels: each level's bitmaps, then nine shifts around twice the coarser level's best.
def level_sql(name: str, src: str, k: int) -> str:
    return f"""{name}z as (select scene_id, floor((max(x)+1)/{2**(k - 1)}e0) as w, floor((max(y)+1)/{2**(k - 1)}e0) as h from gy group by 1),
{name}g as (select *, x0+1 as x1, y0+1 as y1, sx-x0 as fx, sy-y0 as fy from (select *, cast(floor(sx) as int) as x0, cast(floor(sy) as int) as y0 from (select scene_id, cast(tx as int) as tx, cast(ty as int) as ty, tx*(w-1)/floor(w/2) as sx, ty*(h-1)/floor(h/2) as sy
from (select *, unnest(range(0, cast(floor(w/2) as bigint))) as tx from {name}z) cross join lateral (select unnest(range(0, cast(floor(h/2) as bigint))) as ty) u))),
{name} as (select a.scene_id, a.e, tx as x, ty as y, cast(floor((a.l*(1-fx)+b.l*fx)*(1-fy)+(c.l*(1-fx)+d.l*fx)*fy+1e-9) as int) as l from {name}g q join {src} a on a.scene_id = q.scene_id and a.x = x0 and a.y = y0 join {src} b on b.scene_id = a.scene_id and b.e = a.e and b.x = x1 and b.y = y0
join {src} c on c.scene_id = a.scene_id and c.e = a.e and c.x = x0 and c.y = y1 join {src} d on d.scene_id = a.scene_id and d.e = a.e and d.x = x1 and d.y = y1)"""


def search_sql(name: str, src: str, guess: str, scale: int) -> str:
    return f"""{name}b as (select scene_id, e, x, y, l >= t as bit from {src} join gt using (scene_id, e) where abs(l-t) >= 4), {name}s as (select scene_id, e, p, q, {scale}*u+p as i, {scale}*v+q as j from {guess} cross join (select unnest([-1, 0, 1]) as p) cross join (select unnest([-1, 0, 1]) as q)),
{name}e as (select s.scene_id, s.e, s.p, s.q, count(*) filter (b.bit <> a.bit) as err from {name}s s join {name}b b on b.scene_id = s.scene_id and b.e = s.e join {name}b a on a.scene_id = b.scene_id and a.e = b.e-1 and a.x = b.x-s.i and a.y = b.y-s.j group by 1, 2, 3, 4),
{name} as (select scene_id, e, i as u, j as v from (select *, row_number() over (partition by scene_id, e order by coalesce(err, 0), p, q) as rn from {name}s left join {name}e using (scene_id, e, p, q)) where rn = 1)"""


add("mtb_align_levels", lambda s, d: alignment.mtb_align(views.stack(s, d), levels=2), f"""gy as materialized (select scene_id, exposure_idx as e, x, y, cast(floor(greatest(0e0, least(1e0, 0.2126729e0*r+0.7151522e0*g+0.072175e0*b))*255e0+0.5e0) as int) as l from stack), gh as (select scene_id, e, l, count(*) as n from gy group by 1, 2, 3),
gt as materialized (select scene_id, e, min(l) as t from (select *, sum(n) over (partition by scene_id, e order by l) as c, sum(n) over (partition by scene_id, e) as a from gh) where c >= floor(a*0.5e0) group by 1, 2), {level_sql('ga', 'gy', 1).replace('ga as (', 'ga as materialized (')}, {level_sql('gd', 'ga', 2).replace('gd as (', 'gd as materialized (')},
g0 as (select distinct scene_id, e, 0 as u, 0 as v from gy where e > 0), {search_sql('m2', 'gd', 'g0', 1)}, {search_sql('m1', 'ga', 'm2', 2)}, {search_sql('m0', 'gy', 'm1', 2)}, mm as (select scene_id, e, u, v from m0 union all select distinct scene_id, 0, 0, 0 from gy)
select scene_id, cast(e as int) as exposure_idx, cast(sum(u) over (partition by scene_id order by e) as int) as dx, cast(sum(v) over (partition by scene_id order by e) as int) as dy from mm""")  # fmt: skip
