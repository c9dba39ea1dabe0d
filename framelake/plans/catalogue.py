"""Registered queries, one or more an operator, and the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..operators import brackets, levels, merge, pixels, stats, tonemap
from ..sources import views
from . import extended, render
from .registry import HSL_SQL, LUM, ORACLES, PIX, QUERIES, RGB, WAVE, WX, WY, Y, add, lin, mat, over_px, pct, r6, s6, srgb, three, triple

__all__ = ["ORACLES", "QUERIES", "extended"]


def spaces(src: str, dst: str):
    return lambda px: color.convert_colorspace(px, src, dst)


# B: colour and sample functions
over_px("rgb_to_xyz", spaces("rgb", "xyz"), f"select {PIX}, {triple(mat(color.RGB_TO_XYZ, 'r', 'g', 'b'))} from px")
over_px("xyz_to_rgb", spaces("xyz", "rgb"), f"select {PIX}, {triple(mat(color.XYZ_TO_RGB, 'r', 'g', 'b'))} from px")
over_px("rgb_to_yuv", spaces("rgb", "yuv"), f"select {PIX}, {triple(mat(color.RGB_TO_YUV, 'r', 'g', 'b'))} from px")
over_px("yuv_to_rgb", spaces("yuv", "rgb"), f"select {PIX}, {triple(mat(color.YUV_TO_RGB, 'r', 'g', 'b'))} from px")
over_px("srgb_to_xyz", lambda p: spaces("srgb", "xyz")(pixels.each(p, lambda c: c / 60)), f"l as (select {PIX}, {', '.join(lin(f'({c}/60e0)') + f' as {c}' for c in RGB)} from px) select {PIX}, {triple(mat(color.RGB_TO_XYZ, 'r', 'g', 'b'))} from l")
over_px("xyz_to_srgb", lambda p: spaces("xyz", "srgb")(pixels.each(p, lambda c: c / 60)), f"l as (select {PIX}, {', '.join(f'{e} as {c}' for e, c in zip(mat(color.XYZ_TO_RGB, 'r/60e0', 'g/60e0', 'b/60e0'), RGB, strict=True))} from px) select {PIX}, {triple([srgb(c) for c in RGB])} from l")
over_px("srgb_to_linear", lambda p: pixels.each(p, lambda c: color.srgb_to_linear(c / 60 - 0.1)), f"select {PIX}, {triple([lin(f'({c}/60e0-0.1e0)') for c in RGB])} from px")
over_px("linear_to_srgb", lambda p: pixels.each(p, lambda c: color.linear_to_srgb(c / 60 - 0.1)), f"select {PIX}, {triple([srgb(f'({c}/60e0-0.1e0)') for c in RGB])} from px")
over_px("xyz_to_yu_prime_v_prime", spaces("xyz", "yu'v'"), f"select {PIX}, {triple(['g', '4e0*r/(-2e0*r+12e0*g+3e0*(r+g+b))', '9e0*g/(-2e0*r+12e0*g+3e0*(r+g+b))'])} from px")
over_px("yu_prime_v_prime_to_xyz", lambda p: spaces("yu'v'", "xyz")(spaces("xyz", "yu'v'")(p)), f"select {PIX}, {triple(['r', 'g', 'b'])} from px")
over_px("xyz_to_yxy", spaces("xyz", "yxy"), f"select {PIX}, {triple(['g', 'r/(r+g+b)', 'g/(r+g+b)'])} from px")
over_px("yxy_to_xyz", lambda p: spaces("yxy", "xyz")(spaces("xyz", "yxy")(p)), f"select {PIX}, {triple(['r', 'g', 'b'])} from px")
add("rgb_to_y", lambda s, d: views.px(s, d).select("frame_id", "x", "y", (F.round(color.rgb_to_y(*map(F.col, RGB)), 6)).alias("lum"), F.round(color.srgb_to_y(*[F.col(c) / 60 for c in RGB]), 6).alias("srgb_lum")), f"select {PIX}, round({Y}, 6) as lum, round({mat(color.RGB_TO_XYZ, *[lin(f'({c}/60e0)') for c in RGB])[1]}, 6) as srgb_lum from px")


def cmyk(s, d):
    c = [F.least(F.col(x) / 60, F.lit(1.0)) for x in RGB] + [F.lit(0.25)]
    out = views.px(s, d).select("frame_id", "x", "y", *[e.alias(n) for e, n in zip((*color.cmyk_to_rgb(*c), *color.inverted_cmyk_to_rgb(*c)), ("r", "g", "b", "ri", "gi", "bi"), strict=True)])
    return r6(out, "r", "g", "b", "ri", "gi", "bi")


add("cmyk_to_rgb", cmyk, f"select {PIX}, {', '.join(s6(f'(1e0-least({c}/60e0, 1e0))*0.75e0', c) + ', ' + s6(f'least({c}/60e0, 1e0)*0.25e0', c + 'i') for c in RGB)} from px")
def hsl(p: DataFrame) -> DataFrame:
    return p.withColumns(dict(zip(RGB, color.rgb_to_hsl(*[F.col(c) / 60 for c in RGB]), strict=True)))


over_px("rgb_to_hsl", hsl, f"{HSL_SQL} select {PIX}, {triple(['h', 's', 'l'])} from h3")
over_px("hsl_to_rgb", lambda p: (h := hsl(p)).withColumns(dict(zip(RGB, color.hsl_to_rgb(*[F.col(c) for c in RGB]), strict=True))), f"{HSL_SQL} select {PIX}, {triple([WAVE('0e0'), WAVE('4e0'), WAVE('2e0')])} from h3")
over_px("apply_saturation", lambda p: pixels.apply_saturation(pixels.each(p, lambda c: c / 60), 0.5), f"{HSL_SQL}, h4 as (select {PIX}, h, s*0.5e0 as s, l from h3) select {PIX}, {triple([WAVE('0e0'), WAVE('4e0'), WAVE('2e0')])} from h4")
over_px("apply_gamma", lambda p: pixels.apply_gamma(p, 2.2), f"select {PIX}, {three(f'case when $ > 0 then pow($, {1 / 2.2!r}e0) else 0e0 end')} from px")
over_px("gamma_and_levels", lambda p: pixels.gamma_and_levels(pixels.each(p, lambda c: c / 60), 0.05, 0.9, 0.1, 0.95, 1.3), f"q as (select {PIX}, r/60e0 as r, g/60e0 as g, b/60e0 as b from px) select {PIX}, {three('least(greatest(0.1e0+($-0.05e0)/0.85e0*pow(0.2126e0*r+0.7152e0*g+0.0722e0*b, 0.3e0)*0.85e0, 0e0), 1e0)')} from q")
over_px("normalize_clamp", lambda p: pixels.each(p, lambda c: color.clamp(color.normalize(c, F.lit(5.0), F.lit(40.0)), 0, 1)), f"select {PIX}, {three('least(greatest(($-5e0)/35e0, 0e0), 1e0)')} from px")
over_px("sample_conversion", lambda p: pixels.each(p, lambda c: color.to_float(color.to_uint(c / 120, 8), 8) + color.to_uint(c / 120, 16)), f"select {PIX}, {three('cast(floor($/120e0*255e0+0.5e0) as int)/255e0 + cast(floor($/120e0*65535e0+0.5e0) as int)')} from px")
over_px("calibrate", lambda p: pixels.calibrate(p, 1.5, -3.0), f"select {PIX}, {three('$*1.5e0-3e0')} from px")
over_px("log_irradiance", lambda p: pixels.each(p, lambda c: color.log_irradiance(F.floor(c / 10).cast("double"))), f"select {PIX}, {three('case when floor($/10e0) = 0 then -11.09e0 else ln(floor($/10e0)) end')} from px")
add("quantize_u8", lambda s, d: pixels.quantize(views.px(s, d), 0.0, 60.0, "gamma2.2", 8), f"select {PIX}, {', '.join(f'cast(floor(pow(floor(least(greatest({c}/60e0, 0e0), 1e0)*255e0+0.5e0)/255e0, {1 / 2.2!r}e0)*255e0+1e-9) as int) as {c}' for c in RGB)} from px")
for power in (1.4, 1.8, 2.6):
    add(f"quantize_gamma{power}", lambda s, d, m=f"gamma{power}": pixels.quantize(views.px(s, d), 1.0, 50.0, m, 16), f"select {PIX}, {', '.join(f'cast(floor(pow(least(greatest(({c}-1e0)/49e0, 0e0), 1e0), {1 / power!r}e0)*65535e0+0.5e0) as int) as {c}' for c in RGB)} from px")
add("quantize_linear", lambda s, d: pixels.quantize(views.px(s, d), 1.0, 50.0, "linear", 8), f"select {PIX}, {', '.join(f'cast(floor(floor(least(greatest(({c}-1e0)/49e0, 0e0), 1e0)*255e0+0.5e0)/255e0*255e0+1e-9) as int) as {c}' for c in RGB)} from px")
add("quantize_float", lambda s, d: r6(pixels.quantize(views.px(s, d), 1.0, 50.0, "linear", 32).select("frame_id", "x", "y", *RGB), *RGB), f"select {PIX}, {three('least(greatest(($-1e0)/49e0, 0e0), 1e0)')} from px")
add("quantize_u16", lambda s, d: pixels.quantize(views.px(s, d), 0.0, 60.0, "log", 16), f"select {PIX}, {', '.join(f'cast(floor(pow(least(greatest({c}/60e0, 0e0), 1e0), 2.2e0)*65535e0+0.5e0) as int) as {c}' for c in RGB)} from px")


def rgbe(s, d):
    p = views.px(s, d)
    return p.select("frame_id", "x", "y", *[e.alias(n) for e, n in zip(color.rgbe_pack(*map(F.col, RGB)), ("r", "g", "b", "e"), strict=True)])


def rgbe_round(s, d):
    return r6(rgbe(s, d).select("frame_id", "x", "y", *[e.alias(c) for e, c in zip(color.rgbe_unpack(*map(F.col, ("r", "g", "b", "e"))), RGB, strict=True)]), *RGB)


RGBE = """e0 as (select *, greatest(r,g,b)/179e0 as v from px), e1 as (select *, cast(floor(log2(v)) as int)+1 as e from e0),
e2 as (select frame_id, x, y, cast(floor(r/179e0*256e0/pow(2e0,e)) as int) as r, cast(floor(g/179e0*256e0/pow(2e0,e)) as int) as g, cast(floor(b/179e0*256e0/pow(2e0,e)) as int) as b, e+128 as e from e1)"""
add("rgbe_pack", rgbe, f"{RGBE} select {PIX}, r, g, b, e from e2")
add("rgbe_unpack", rgbe_round, f"{RGBE} select {PIX}, {three('$*pow(2e0, e-136)')} from e2")
for op, form in {"mul": "$*($+1e0)", "div": "$/($+1e0)", "add": "$+($+1e0)", "sub": "$-($*0.25e0)", "adds": "$+0.5e0*($+1e0)"}.items():
    over_px(f"frame_{op}", lambda p, op=op: pixels.frame_arith(p, pixels.each(p, (lambda c: c * 0.25) if op == "sub" else lambda c: c + 1), op, 0.5), f"select {PIX}, {three(form)} from px")
over_px("frame_arith", lambda p: pixels.frame_arith(p, pixels.each(p, lambda c: c + 1), "subs", 0.5), f"select {PIX}, {three('$-0.5e0*($+1e0)')} from px")

# Geometry and neighbours
over_px("crop", lambda p: pixels.crop(p, 3, 2, 20, 15), f"select frame_id, x-3 as x, y-2 as y, {three('$')} from px where x >= 3 and x < 20 and y >= 2 and y < 15")
SHIFTED = lambda c: f"case when x >= 2 then coalesce(lead({c}, 22) over (partition by frame_id order by y, x), 0e0) else 0e0 end"  # noqa: E731  lines are 24 pixels wide
over_px("shift", lambda p: pixels.shift(p, -2, 1), f"select {PIX}, {triple([SHIFTED(c) for c in RGB])} from px")
over_px("rotate_clockwise", lambda p: pixels.rotate(p, True), f"z as (select frame_id, max(x)+1 as w, max(y)+1 as h from px group by 1) select frame_id, h-1-y as x, x as y, {three('$')} from px join z using (frame_id)")
over_px("rotate_counterclockwise", lambda p: pixels.rotate(p, False), f"z as (select frame_id, max(x)+1 as w, max(y)+1 as h from px group by 1) select frame_id, y as x, w-1-x as y, {three('$')} from px join z using (frame_id)")
over_px("resize_bilinear", lambda p: pixels.resize_bilinear(p, 10), """z as (select frame_id, max(x)+1 as w, max(y)+1 as h from px group by 1), t as (select frame_id, w, h, cast(floor(h*10/w) as int) as h2 from z),
g1 as (select frame_id, w, h, h2, cast(unnest(range(10)) as int) as x2 from t), g2 as (select *, cast(unnest(range(h2)) as int) as y2 from g1),
g3 as (select *, x2*(w-1)/10e0 as sx, y2*(h-1)/cast(h2 as double) as sy from g2), g4 as (select *, cast(floor(sx) as int) as x0, cast(floor(sy) as int) as y0 from g3)
select a.frame_id, x2 as x, y2 as y, """ + ", ".join(s6(f"(p.{c}*(1e0-(sx-x0))+coalesce(q.{c},0e0)*(sx-x0))*(1e0-(sy-y0)) + (coalesce(u.{c},0e0)*(1e0-(sx-x0))+coalesce(v.{c},0e0)*(sx-x0))*(sy-y0)", c) for c in RGB) + """ from g4 a
join px p on p.frame_id=a.frame_id and p.x=x0 and p.y=y0 left join px q on q.frame_id=a.frame_id and q.x=x0+1 and q.y=y0 left join px u on u.frame_id=a.frame_id and u.x=x0 and u.y=y0+1 left join px v on v.frame_id=a.frame_id and v.x=x0+1 and v.y=y0+1""")  # fmt: skip
add("gradients_forward", lambda s, d: r6(pixels.gradients(views.px(s, d), "g").select("frame_id", "x", "y", "gx", "gy"), "gx", "gy"), f"select {PIX}, {s6(f'coalesce(lead(g) over {WX} - g, 0e0)', 'gx')}, {s6(f'coalesce(lead(g) over {WY} - g, 0e0)', 'gy')} from px")
add("gradients_central", lambda s, d: r6(pixels.gradients(views.px(s, d), "g", "central").select("frame_id", "x", "y", "gx", "gy"), "gx", "gy"), f"select {PIX}, {s6(f'(lead(g,1,0e0) over {WX} - lag(g,1,0e0) over {WX})/2e0', 'gx')}, {s6(f'(lead(g,1,0e0) over {WY} - lag(g,1,0e0) over {WY})/2e0', 'gy')} from px")
GRAD = f"gr as (select {PIX}, coalesce(lead(g) over {WX} - g, 0e0) as gx, coalesce(lead(g) over {WY} - g, 0e0) as gy from px)"
add("divergence", lambda s, d: r6(pixels.divergence(pixels.gradients(views.px(s, d), "g")).select("frame_id", "x", "y", "div"), "div"), f"{GRAD} select {PIX}, {s6(f'gx - lag(gx,1,0e0) over {WX} + gy - lag(gy,1,0e0) over {WY}', 'div')} from gr")
add("blur_binomial", lambda s, d: r6(pixels.blur(views.px(s, d), "g").select("frame_id", "x", "y", "g"), "g"), f"b1 as (select {PIX}, (2e0*g+coalesce(lag(g) over {WX}, g)+coalesce(lead(g) over {WX}, g))/4e0 as g from px) select {PIX}, {s6(f'(2e0*g+coalesce(lag(g) over {WY}, g)+coalesce(lead(g) over {WY}, g))/4e0', 'g')} from b1")
add("downsample2", lambda s, d: r6(pixels.downsample2(views.px(s, d), "g"), "g"), f"z as (select frame_id, max(x)+1 as w, max(y)+1 as h from px group by 1) select frame_id, cast(floor(x/2) as int) as x, cast(floor(y/2) as int) as y, {s6('avg(g)', 'g')} from px join z using (frame_id) where x < floor(w/2)*2 and y < floor(h/2)*2 group by 1, 2, 3")
add("contrast_equalize", lambda s, d: r6(pixels.contrast_equalize(pixels.gradients(views.px(s, d), "g").select("frame_id", "x", "y", "gx", "gy"), 0.5).select("frame_id", "x", "y", "gx", "gy"), "gx", "gy"), f"{GRAD}, mg as (select *, round(sqrt(gx*gx+gy*gy), 9) as m from gr), cd as (select *, cume_dist() over (partition by frame_id order by m) as c from mg) select {PIX}, {s6('case when m > 0 then gx*0.5e0*c/m else 0e0 end', 'gx')}, {s6('case when m > 0 then gy*0.5e0*c/m else 0e0 end', 'gy')} from cd")

# D: statistics
def lum(s, d):
    return stats.luminance(views.px(s, d))


add("inspect", lambda s, d: r6(stats.inspect(views.px(s, d).withColumn("v", F.when(F.col("x") == 3, float("nan")).when(F.col("x") == 4, float("inf")).otherwise(F.col("g"))), "v"), "lo", "hi"), f"select frame_id, count(*) as n, {s6('min(case when x not in (3,4) then g end)', 'lo')}, {s6('max(case when x not in (3,4) then g end)', 'hi')}, count(*) filter (x=3) as nans, count(*) filter (x=4) as infs from px group by 1")
add("frame_minmax", lambda s, d: r6(stats.frame_minmax(views.px(s, d)), "lo", "hi"), f"select frame_id, {s6('min(least(r,g,b))', 'lo')}, {s6('max(greatest(r,g,b))', 'hi')} from px group by 1")
add("log_average", lambda s, d: r6(stats.log_average(lum(s, d), "lum", 1e-4), "log_avg"), f"{LUM} select frame_id, {s6('exp(avg(ln(lum+1e-4)))', 'log_avg')} from lm group by 1")
add("luminance_properties", lambda s, d: r6(stats.luminance_properties(lum(s, d), 0.5), "ln_max", "ln_min", "adapted", "mean", "key", "contrast", "bright"), f"{LUM}, p0 as (select frame_id, ln(max(lum)) as ln_max, ln(min(lum)) as ln_min, avg(ln(lum+2.3e-5)) as adapted, avg(lum) as mean from lm group by 1), p1 as (select *, (ln_max-adapted)/(ln_max-ln_min) as key from p0) select frame_id, {', '.join(s6(c, c) for c in ('ln_max', 'ln_min', 'adapted', 'mean', 'key'))}, {s6('0.3e0+0.7e0*pow(key, 1.4e0)', 'contrast')}, {s6('exp(-0.5e0)', 'bright')} from p1")
add("dot", lambda s, d: stats.dot(views.px(s, d), "r", "g").select("frame_id", *[F.round(c, 3).alias(c) for c in ("dot", "total", "squares")]), "select frame_id, round(sum(r*g), 3) as dot, round(sum(r), 3) as total, round(sum(r*r), 3) as squares from px group by 1")
add("histogram_linear", lambda s, d: stats.histogram(stats.with_stats(views.px(s, d), stats.frame_minmax(views.px(s, d))), stats.rounded_bin(F.col("g"), F.col("lo"), F.col("hi"), 64)), "z as (select frame_id, min(least(r,g,b)) as lo, max(greatest(r,g,b)) as hi from px group by 1) select frame_id, cast(floor((g-lo)/(hi-lo)*63e0+0.5e0) as int) as bin, count(*) as n from px join z using (frame_id) group by 1, 2")
add("histogram_log", lambda s, d: stats.cumulate(stats.histogram(views.px(s, d), F.when(F.col("g") > 0, F.floor(F.log10("g") * 10).cast("int")))), "hh as (select frame_id, cast(floor(log10(g)*10e0) as int) as bin, count(*) as n from px where g > 0 group by 1, 2) select *, cast(sum(n) over (partition by frame_id order by bin) as bigint) as cum from hh")
QUANT = lambda c: f"z{c} as (select frame_id, min({c}) as lo, max({c}) as hi, count(*) as total from px group by 1), h{c} as (select frame_id, lo, hi, total, cast(floor(({c}-lo)/(hi-lo)*65534e0+0.5e0) as int) as bin, count(*) as n from px join z{c} using (frame_id) group by 1,2,3,4,5), c{c} as (select *, sum(n) over (partition by frame_id order by bin) as cum from h{c}), k{c} as (select frame_id, lo+min(case when cum >= 0.005e0*total then bin end)*(hi-lo)/65534e0 as a{c}, lo+min(case when cum >= 0.995e0*total then bin end)*(hi-lo)/65534e0 as b{c} from c{c} group by frame_id, lo, hi)"
add("hist_quantiles", lambda s, d: r6(stats.hist_quantiles(views.px(s, d), "g", 0.005, 0.995), "q_lo", "q_hi"), f"{QUANT('g')} select frame_id, {s6('ag', 'q_lo')}, {s6('bg', 'q_hi')} from kg")
over_px("wb_color_balance", stats.wb_color_balance, f"{QUANT('r')}, {QUANT('g')}, {QUANT('b')} select {PIX}, {three('(least(greatest($, a$), b$)-a$)/(b$-a$)')} from px join kr using (frame_id) join kg using (frame_id) join kb using (frame_id)")
over_px("wb_shades_of_gray", stats.wb_shades_of_gray, f"e as (select frame_id, {', '.join(f'pow(avg(pow({c}, 6e0)), {1 / 6!r}e0) as e{c}' for c in RGB)} from px group by 1) select {PIX}, {three('$*greatest(er,eg,eb)/e$')} from px join e using (frame_id)")
add("minkowski_mean", lambda s, d: r6(stats.minkowski_mean(views.px(s, d)), *RGB), f"select frame_id, {three(f'pow(avg(pow($, 6e0)), {1 / 6!r}e0)')} from px group by 1")
YUV = lambda g: f"q{g} as (select frame_id, gr, gb, (0.299e0*r*gr+0.587e0*g+0.144e0*b*gb) as y, (-0.299e0*r*gr-0.587e0*g+0.886e0*b*gb) as u, (0.701e0*r*gr-0.587e0*g-0.114e0*b*gb) as v from px join g{g} using (frame_id)), b{g} as (select frame_id, gr, gb, avg(case when (abs(u)+abs(v))/y < 0.3e0 then u end) as ub, avg(case when (abs(u)+abs(v))/y < 0.3e0 then v end) as vb from q{g} group by 1,2,3), d{g} as (select *, case when abs(ub) > abs(vb) then ub else vb end as err from b{g}), f{g} as (select *, case when ub is null or abs(err) >= 10e0 or abs(err) < 0.001e0 then 0e0 when abs(err) >= 0.8e0 then 0.6e0*sign(err) else 0.3e0*err end as dl from d{g}), g{g + 1} as (select frame_id, case when abs(ub) > abs(vb) then gr else gr-dl end as gr, case when abs(ub) > abs(vb) then gb-dl else gb end as gb from f{g})"
add("wb_robust", lambda s, d: r6(stats.wb_robust(views.px(s, d)), "gain_r", "gain_b"), f"g0 as (select distinct frame_id, 1e0 as gr, 1e0 as gb from px), {YUV(0)}, {YUV(1)}, {YUV(2)} select frame_id, {s6('gr', 'gain_r')}, {s6('gb', 'gain_b')} from g3")
add("robust_center", lambda s, d: r6(stats.robust_center(views.px(s, d), "g"), "center"), f"select frame_id, {s6('sqrt(avg(g)*quantile_disc(g, 0.5))', 'center')} from px group by 1")
add("dynamic_range_window", lambda s, d: r6(stats.dynamic_range_window(lum(s, d)), "lo", "hi"), f"{LUM}, w as (select frame_id, log10(greatest(min(lum), 1e-6)) as lo, log10(greatest(max(lum), 1e-6)) as hi from lm group by 1) select frame_id, {s6('lo-greatest(0.5e0-(hi-lo), 0e0)/2e0', 'lo')}, {s6('hi+greatest(0.5e0-(hi-lo), 0e0)/2e0', 'hi')} from w")
add("stats_rollup", lambda s, d: r6(stats.stats_rollup(views.stack(s, d).withColumn("g", F.when(F.col("x") == 3, float("nan")).when(F.col("x") == 4, float("inf")).otherwise(F.col("g")))), "lo", "hi", "mean", "log_avg"), f"select scene_id, exposure_idx, count(*) as n, {s6('min(g) filter (x not in (3,4))', 'lo')}, {s6('max(g) filter (x not in (3,4))', 'hi')}, {s6('avg(g) filter (x not in (3,4))', 'mean')}, {s6('exp(avg(ln(g+1e-6)) filter (x not in (3,4)))', 'log_avg')}, count(*) filter (x=3) as nans, count(*) filter (x=4) as infs from stack group by rollup (scene_id, exposure_idx)")
add("top_frames", lambda s, d: r6(stats.top_frames(stats.log_average(lum(s, d), "lum", 1e-4), "log_avg", 5), "log_avg"), f"{LUM}, a as (select frame_id, exp(avg(ln(lum+1e-4))) as v from lm group by 1) select frame_id, {s6('v', 'log_avg')} from a order by v desc, frame_id limit 5")

# I: tone mapping
over_px("tm_drago", tonemap.tm_drago, f"z as (select frame_id, max(g) as top, exp(avg(ln(g+1e-4))) as av from px group by 1), q as (select px.*, g/av as w, top/av as t from px join z using (frame_id)), n as (select *, ln(w+1e0)/(ln(2e0+8e0*exp((ln(0.85e0)/ln(0.5e0))*(ln(w)-ln(t))))*log10(t+1e0)) as l from q) select {PIX}, {three('$*(case when g <> 0 then l/g else 0e0 end)')} from n")
over_px("tm_reinhard02", tonemap.tm_reinhard02, f"{LUM}, z as (select frame_id, exp(avg(ln(lum+1e-5))) as av, max(lum) as top from lm group by 1), q as (select lm.*, lum*0.18e0/av as v, top*0.18e0/av as t from lm join z using (frame_id)) select {PIX}, {three('$*(v*(1e0+v/(t*t))/(1e0+v))/lum')} from q")
over_px("tm_reinhard05", lambda p: tonemap.tm_reinhard05(p, 0.5, 0.3, 0.8), f"{LUM}, p0 as (select frame_id, ln(max(lum)) as lx, ln(min(lum)) as ln0, avg(ln(lum+2.3e-5)) as ad, avg(lum) as ml, avg(r) as mr, avg(g) as mg, avg(b) as mb from lm group by 1), p1 as (select *, 0.3e0+0.7e0*pow((lx-ad)/(lx-ln0), 1.4e0) as k from p0), o as (select {PIX}, {', '.join(f'{c}/({c}+pow(exp(-0.5e0)*(0.8e0*(0.3e0*{c}+0.7e0*lum)+0.2e0*(0.3e0*m{c}+0.7e0*ml)), k)) as {c}' for c in RGB)} from lm join p1 using (frame_id)), z as (select frame_id, min(least(r,g,b)) as lo, max(greatest(r,g,b)) as hi from o group by 1) select {PIX}, {three('($-lo)/(hi-lo)')} from o join z using (frame_id)")
TP = lambda x: f"pow(10e0, case when log10({x}) <= -2.6e0 then -0.72e0 when log10({x}) >= 1.9e0 then log10({x})-1.255e0 else pow(0.249e0*log10({x})+0.65e0, 2.7e0)-0.72e0 end)"
TS = lambda x: f"pow(10e0, case when log10({x}) <= -3.94e0 then -2.86e0 when log10({x}) >= -1.44e0 then log10({x})-0.395e0 else pow(2.18e0, 0.405e0*log10({x})+1.6e0)-2.86e0 end)"
over_px("tm_ferwerda", tonemap.tm_ferwerda, f"q as (select *, {mat(color.RGB_TO_XYZ, 'g', 'r', 'b')[1]} as lum from px), z as (select frame_id, max(lum)*0.5e0 as w, 1e0/max(greatest(r,g,b)) as s, 0.01e0 as a from q group by 1), k as (select frame_id, s, {TP('a')}/{TP('w')} as mc, {TS('a')}/{TS('w')}*greatest((a-w/4e0)/(a+w), 0e0) as mr from z) select {PIX}, {triple([f'(mc*{c}+{v}e0*mr*lum)*s' for c, v in zip(RGB, (0.97, 1.05, 1.27), strict=True)])} from q join k using (frame_id)")
CAP = lambda x: f"(case when {x} <= 1e-20 then 0e0 when {x} < 0.0034e0 then {x}/0.0014e0 when {x} < 1e0 then 2.4483e0+ln({x}/0.0034e0)/0.4027e0 when {x} < 7.2444e0 then 16.563e0+({x}-1e0)/0.4027e0 else 32.0693e0+ln({x}/7.2444e0)/0.0556e0 end)"
over_px("tm_ashikhmin_simple", tonemap.tm_ashikhmin_simple, f"{LUM}, z as (select frame_id, max(lum) as top from lm group by 1), c as (select lm.*, 500e0*{CAP('lum')}/{CAP('top')} as cap from lm join z using (frame_id)), s as (select frame_id, min(cap) as lo, max(cap) as hi from c group by 1) select {PIX}, {three('$*((cap-lo)/(hi-lo))/lum')} from c join s using (frame_id)")
add("render", lambda s, d: render.render(views.px(s, d), "drago", pregamma=1.2, postgamma=1.5, bits=32).select("frame_id", "x", "y", *[F.round(c, 6).alias(c) for c in RGB]), f"a as (select {PIX}, {', '.join(f'pow({c}, {1 / 1.2!r}e0) as {c}' for c in RGB)} from px), z as (select frame_id, max(g) as top, exp(avg(ln(g+1e-4))) as av from a group by 1), q as (select a.*, g/av as w, top/av as t from a join z using (frame_id)), n as (select *, ln(w+1e0)/(ln(2e0+8e0*exp((ln(0.85e0)/ln(0.5e0))*(ln(w)-ln(t))))*log10(t+1e0)) as l from q) select {PIX}, {', '.join(f'round(least(greatest(pow({c}*l/g, {1 / 1.5!r}e0), 0e0), 1e0), 6) as {c}' for c in RGB)} from n")
add("batch_plan", lambda s, d: render.batch_plan(pixels.frame_sizes(views.px(s, d)), s.sql("select 'drago' as tmo, 1e0 as pregamma union all select 'ferwerda', 2e0")), "select frame_id, max(x)+1 as width, max(y)+1 as height, tmo, pregamma from px cross join (select 'drago' as tmo, 1e0 as pregamma union all select 'ferwerda', 2e0) t group by frame_id, tmo, pregamma")

# Files and exposures
META = """mt as (select *, coalesce(exposure_time, case when pow(2e0, shutter_speed_value) > 1 then 1e0/floor(pow(2e0, shutter_speed_value)+0.5e0) else cast(floor(pow(2e0, -shutter_speed_value)+0.5e0) as double) end) as t,
coalesce(f_number, pow(2e0, aperture_value/2e0), sqrt(2e0)) as n, coalesce(iso, 100e0) as sp from meta), me as (select *, log2(n*n/t) as ev from mt)"""
add("exposure_metadata", lambda s, d: r6(merge.exposure_metadata(views.meta(s, d)).select("file_id", "time", "number", "speed", "ev", "avg_lum"), "time", "number", "speed", "ev", "avg_lum"), f"{META} select file_id, {s6('t', 'time')}, {s6('n', 'number')}, {s6('sp', 'speed')}, {s6('ev', 'ev')}, {s6('t*sp/(n*n*12.07488e0)', 'avg_lum')} from me")
add("orientation_degrees", lambda s, d: views.meta(s, d).select("file_id", color.orientation_degrees(F.col("orientation")).alias("degrees")), "select file_id, case orientation when 3 then 180 when 6 then 90 when 8 then 270 else 0 end as degrees from meta")
add("missing_exposure", lambda s, d: merge.missing_exposure(views.meta(s, d)), f"{META} select file_id, file from me where ev is null")
add("new_files", lambda s, d: merge.new_files(views.meta(s, d).select("file", "file_id"), views.meta(s, d).where("file_id % 3 = 0").select("file")), "select file, file_id from meta where file_id % 3 <> 0")
add("assign_brackets", lambda s, d: merge.assign_brackets(views.meta(s, d).select("folder_id", "file_id", "file"), 3), "select folder_id, file_id, file, cast(floor((rn-1)/3) as int) as bracket, cast((rn-1) % 3 as int) as place from (select *, row_number() over (partition by folder_id order by file) as rn from meta)")
WIDE, HIGH = "case when file_id % 7 = 0 then 4000 else 6000 end", "case when file_id % 7 = 0 then 3000 else 4000 end"
add("validate_brackets", lambda s, d: merge.validate_brackets(merge.assign_brackets(views.meta(s, d).withColumns({"width": F.expr(f"case when orientation in (6, 8) then {HIGH} else {WIDE} end"), "height": F.expr(f"case when orientation in (6, 8) then {WIDE} else {HIGH} end")}), 3), 3), f"a as (select *, cast(floor((row_number() over (partition by folder_id order by file)-1)/3) as int) as bracket from meta) select folder_id, bracket, count(*) as files, count(distinct {WIDE}) as sizes, count(*) = 3 and count(distinct {WIDE}) = 1 as valid from a group by 1, 2")
add("ev_offset", lambda s, d: r6(merge.ev_offset(merge.exposure_metadata(views.meta(s, d))).select("file_id", "ev_offset", "relative"), "ev_offset", "relative"), f"{META}, o as (select folder_id, quantile_disc(ev, 0.5) as o from me where ev is not null group by 1) select file_id, {s6('o', 'ev_offset')}, {s6('pow(2e0, ev-o)', 'relative')} from me join o using (folder_id) where ev is not null")

# E2, C1, G: exposure merge
add("rank_exposures", lambda s, d: merge.rank_exposures(views.stack(s, d)), "select distinct scene_id, exposure_idx, pow(2e0, ev) as time, case when exposure_idx > 0 then exposure_idx-1 end as darker_idx from stack")
Q = lambda c: f"(floor({c}*4095e0)/4095e0)"
TRI = lambda c: f"(case when {Q(c)} < {2 / 4096!r}e0 or {Q(c)} > 1e0-{2 / 4096!r}e0 then 0e0 when {Q(c)} < 0.5e0 then 2e0*{Q(c)} else 2e0*(1e0-{Q(c)}) end)"
RES = lambda c: f"(greatest(floor({c}*4095e0), 1e0)/4095e0)"
DARK = f"dk as (select a.scene_id, a.x, a.y, a.exposure_idx as i, pow(2e0, a.ev) as t, a.r, a.g, a.b, d.r as dr, d.g as dg, d.b as db from stack a left join stack d on a.scene_id = d.scene_id and a.x = d.x and a.y = d.y and d.exposure_idx = a.exposure_idx-1)"
add("darker_samples", lambda s, d: r6(merge.darker_samples(views.stack(s, d)).select("scene_id", "exposure_idx", "x", "y", "dark_r", "dark_g", "dark_b"), "dark_r", "dark_g", "dark_b"), f"select scene_id, exposure_idx, x, y, {', '.join(s6(f'lag({c}) over (partition by scene_id, x, y order by exposure_idx)', f'dark_{c}') for c in RGB)} from stack")
DEB = f"{DARK}, wt as (select *, case when dr is null then greatest(({TRI('r')}+{TRI('g')}+{TRI('b')})/3e0, 1e-6) else ({TRI('r')}+{TRI('g')}+{TRI('b')})/3e0*greatest(0e0, least(1e0, 1e0-pow(4e0*{RES('dr')}, 4e0), 1e0-pow(4e0*{RES('dg')}, 4e0), 1e0-pow(4e0*{RES('db')}, 4e0))) end as w from dk)"
MERGED = f"mg as (select scene_id, x, y, {', '.join(f'exp(sum(w*(ln({RES(c)})-ln(t)))/sum(w)) as {c}' for c in RGB)} from wt group by 1, 2, 3)"
add("merge_debevec", lambda s, d: r6(merge.merge(views.stack(s, d)), *RGB), f"{DEB}, {MERGED} select scene_id, x, y, {three('$')} from mg")
add("repair_normalize", lambda s, d: r6(merge.repair_normalize(merge.merge(views.stack(s, d))), *RGB), f"{DEB}, {MERGED}, z as (select scene_id, min(least(r,g,b)) as lo, max(greatest(r,g,b)) as hi from mg group by 1) select scene_id, x, y, {three('($-lo)/(hi-lo)')} from mg join z using (scene_id)")
ROB = lambda c: f"(case when dr is null then greatest({TRI(c)}, 1e-6) else {TRI(c)}*greatest(0e0, 1e0-pow(4e0*{RES('d' + c)}, 4e0)) end)"
add("merge_robertson", lambda s, d: r6(merge.merge_robertson(views.stack(s, d)), *RGB), f"{DARK} select scene_id, x, y, {', '.join(s6(f'case when sum({ROB(c)}*t) <> 0 then sum({ROB(c)}*{RES(c)})/sum({ROB(c)}*t) else 0e0 end', c) for c in RGB)} from dk group by 1, 2, 3")
add("weights", lambda s, d: r6(views.px(s, d).select("frame_id", "x", "y", *[color.weight(F.least(F.col("g") / 120, F.lit(1.0)), k).alias(k) for k in ("triangular", "gaussian", "plateau", "flat")]), "triangular", "gaussian", "plateau", "flat"), f"q as (select {PIX}, floor(least(g/120e0, 1e0)*4095e0)/4095e0 as m from px) select {PIX}, {s6(f'case when m < {2 / 4096!r}e0 or m > 1e0-{2 / 4096!r}e0 then 0e0 when m < 0.5e0 then 2e0*m else 2e0*(1e0-m) end', 'triangular')}, {s6(f'case when m < {2 / 4096!r}e0 or m > 1e0-{2 / 4096!r}e0 then 0e0 else exp(-32e0*(m-0.5e0)*(m-0.5e0)) end', 'gaussian')}, {s6('case when m < 0.00025e0 or m > 0.99975e0 then 0e0 else 1e0-pow(2e0*m-1e0, 12e0) end', 'plateau')}, {s6('1e0', 'flat')} from q")
add("responses", lambda s, d: r6(views.px(s, d).select("frame_id", "x", "y", *[color.response(F.least(F.col("g") / 120, F.lit(1.0)), k).alias(k) for k in ("linear", "gamma", "log10", "srgb")]), "linear", "gamma", "log10", "srgb"), f"q as (select {PIX}, greatest(floor(least(g/120e0, 1e0)*4095e0), 1e0)/4095e0 as m from px) select {PIX}, {s6('m', 'linear')}, {s6('pow(4e0*m, 1.7e0)+1e-4', 'gamma')}, {s6('1e-8*pow(10e0, m/0.0625e0-8e0)', 'log10')}, {s6(lin('m'), 'srgb')} from q")

add("percentiles", lambda s, d: r6(levels.percentiles(lum(s, d), "lum", 0.01, 0.99), "q_lo", "q_hi"), f"{LUM}, {pct('pp', 'lm', 'lum', 'frame_id', 0.01, 0.99)} select frame_id, {s6('q_lo', 'q_lo')}, {s6('q_hi', 'q_hi')} from pp")
over_px("tm_kimkautz", levels.tm_kimkautz, f"{LUM}, k0 as (select frame_id, avg(ln(lum+1e-6)) as mu, max(ln(lum+1e-6))-min(ln(lum+1e-6)) as rg from lm group by 1), k1 as (select lm.*, mu, rg, (ln(300e0)-ln(0.3e0))/rg as k from lm join k0 using (frame_id)), k2 as (select *, exp(0.5e0*((1e0-k)*exp(-(lum-mu)*(lum-mu)/(2e0*(rg/3e0)*(rg/3e0)))+k)*(ln(lum+1e-6)-mu)+mu) as v from k1), {pct('pk', 'k2', 'v', 'frame_id', 0.01, 0.99)} select {PIX}, {three('$*((least(greatest(v, q_lo), q_hi)-q_lo)/(q_hi-q_lo))/lum')} from k2 join pk using (frame_id)")
AT = lambda c: f"((log10(greatest({c}, 1e-5))+6e0)/0.1e0+1e-9)"
over_px("tm_mai", levels.tm_mai, f"mh as (select frame_id, cast(floor({AT('g')}) as int) as bin, cbrt(count(*)) as rise from px group by 1, 2), mw as (select frame_id, sum(rise) as whole from mh where bin < 150 group by 1), mg as (select frame_id, whole, unnest(range(150)) as i from mw), mc as (select mg.frame_id, i, coalesce(sum(rise), 0e0)/any_value(whole) as v from mg left join mh on mh.frame_id = mg.frame_id and bin between 1 and i group by 1, 2), ml as (select frame_id, list(v order by i) as vs from mc group by 1), mp as (select {PIX}, vs, {', '.join(f'{AT(c)} as {c}, cast(least(floor({AT(c)}), 149) as int) as i{c}' for c in RGB)} from px join ml using (frame_id)) select {PIX}, {three('vs[i$+1]+(vs[least(i$+2, 150)]-vs[i$+1])*($-i$)')} from mp")
ZONES = f"""{LUM}, {pct('pz', 'lm', 'lum', 'frame_id', 0.01, 0.99)}, za as (select frame_id, exp(avg(ln(lum+1e-6))) as av from lm group by 1), zb as (select frame_id, av, log2(q_lo+1e-6) as mn, log2(q_hi+1e-6)-log2(q_lo+1e-6) as rg from pz join za using (frame_id)),
zc as (select *, 0.18e0*pow(4e0, (2e0*(log2(av+1e-6)-mn)-rg)/rg) as ky, 1.5e0*pow(2e0, rg-5e0) as wh from zb), zl as (select lm.*, cast(greatest(0e0, least(ceil(rg)-1e0, ceil(log2(lum+1e-6)-mn-1e-9))) as int) as zone from lm join zc using (frame_id)), {pct('pm', 'zl', 'lum', 'frame_id, zone', 0.5, 0.5)},
zd as (select frame_id, zone, q_lo, q_lo*ky/av as b, wh from pm join zc using (frame_id)), zs as (select frame_id, zone, log2(b*(1e0+b/(wh*wh))/(1e0+b)/q_lo+1e-6) as stop from zd)"""
add("zone_exposure", lambda s, d: r6(levels.zone_exposure(views.px(s, d))[1], "stop"), f"{ZONES} select frame_id, zone, {s6('stop', 'stop')} from zs")
over_px("tm_zone", levels.tm_zone, f"{ZONES} select {PIX}, {three('$*pow(2e0, stop)')} from zl join zs using (frame_id, zone)")
AUTO = lambda share: f"""ah as (select frame_id, ch, bin, count(*) as n from (select frame_id, 'r' as ch, r as bin from au union all select frame_id, 'g', g from au union all select frame_id, 'b', b from au union all select frame_id, 'light', cast(floor((greatest(r,g,b)+least(r,g,b))/2) as int) from au) group by 1, 2, 3),
ap as (select frame_id, ch, greatest(1, least(254, min(bin))) as pk from (select *, max(n) over (partition by frame_id, ch) as top from ah) where n = top group by 1, 2), ag as (select *, unnest(range(256)) as bin from ap), ad as (select ag.*, coalesce(n, 0) as n from ag left join ah using (frame_id, ch, bin)),
aw as (select *, sum(case when bin < pk then n else 0 end) over (partition by frame_id, ch order by bin desc) as bl, sum(case when bin < pk then n else 0 end) over (partition by frame_id, ch) as lt, sum(case when bin >= pk then n else 0 end) over (partition by frame_id, ch order by bin) as ab, sum(case when bin >= pk then n else 0 end) over (partition by frame_id, ch) as rt from ad),
ae as (select frame_id, ch, coalesce(max(case when bin >= 1 and bin < pk and bl >= {share!r}e0*lt then bin end), 0) as xa, coalesce(min(case when bin >= pk and bin < 254 and ab >= {share!r}e0*rt then bin+1 end), 255) as xb from aw group by 1, 2)"""  # noqa: E731
add("auto_levels", lambda s, d: r6(levels.auto_levels(pixels.quantize(views.px(s, d), 0.0, 60.0), 0.9), "lo", "hi", "gamma"), f"""au as (select frame_id, {', '.join(f'cast(floor(floor(least(greatest({c}/60e0, 0e0), 1e0)*255e0+0.5e0)/255e0*255e0+1e-9) as int) as {c}' for c in RGB)} from px),
{AUTO(0.9)}
select frame_id, {s6('min(xa)/255e0', 'lo')}, {s6('max(xb)/255e0', 'hi')}, 1e0 as gamma from ae group by 1""")  # fmt: skip
add("upsample2", lambda s, d: r6(levels.upsample2(views.px(s, d), "g"), "g"), f"select frame_id, cast(x*2+i as int) as x, cast(y*2+j as int) as y, {s6('g', 'g')} from px cross join (select unnest(range(2)) as i) cross join (select unnest(range(2)) as j)")

# Whole brackets
add("reference_exposure", lambda s, d: r6(brackets.reference_exposure(views.stack(s, d)), "spread"), f"{HSL_SQL.replace('frame_id, x, y, r/60e0 as r, g/60e0 as g, b/60e0 as b from px', 'scene_id, exposure_idx, x, y, r, g, b from stack').replace('select frame_id', 'select scene_id')}, o1 as (select *, h-avg(h) over (partition by scene_id, x, y) as o from h3), o2 as (select scene_id, exposure_idx, round(avg(o*o), 9) as spread from o1 group by 1, 2) select scene_id, cast(exposure_idx as int) as exposure_idx, {s6('spread', 'spread')} from (select *, row_number() over (partition by scene_id order by spread desc, exposure_idx) as rn from o2) where rn = 1")
DV = lambda c: f"case when greatest(s.r,s.g,s.b,o.r,o.g,o.b) < 1 and least(s.r,s.g,s.b,o.r,o.g,o.b) > 0 then abs(ln(s.{c})-ln(o.{c})-sign(s.ev-o.ev)*ln(abs(s.ev-o.ev))) else 0e0 end"
add("pair_deviation", lambda s, d: r6(brackets.pair_deviation(views.stack(s, d), 1), "dev_r", "dev_g", "dev_b"), f"select scene_id, s.exposure_idx, {', '.join(s6(f'avg({DV(c)})+stddev_pop({DV(c)})', f'dev_{c}') for c in RGB)} from stack s join stack o using (scene_id, x, y) where o.exposure_idx = 1 and s.exposure_idx <> 1 group by 1, 2")


def bright_patches(spark, sf_dir, exposure: int) -> DataFrame:
    patch = [F.floor(F.col(c) / 4).cast("int").alias(f"p{c}") for c in ("x", "y")]
    return views.stack(spark, sf_dir).where((F.col("exposure_idx") == exposure) & (F.col("r") >= 1)).select("scene_id", *patch).distinct()


for how in ("union", "intersect", "subtract"):
    masks = [f"select scene_id, cast(floor(x/4) as int) as px, cast(floor(y/4) as int) as py from stack where exposure_idx = {i} and r >= 1" for i in (1, 2)]
    first, second = (1, 2) if how != "subtract" else (2, 1)
    add(f"combine_masks_{how}", lambda s, d, how=how, a=first, b=second: brackets.combine_masks(bright_patches(s, d, a), bright_patches(s, d, b), how), f"select * from ({masks[first - 1]} {'except' if how == 'subtract' else how} {masks[second - 1]})")


def pair_shifts(spark, sf_dir) -> DataFrame:
    return views.stack(spark, sf_dir).select("scene_id", "exposure_idx").distinct().select("*", (F.col("scene_id") % 3 * F.signum("exposure_idx")).cast("int").alias("dx"), F.signum("exposure_idx").cast("int").alias("dy"))


MOVES = "sh as (select scene_id, exposure_idx, cast(scene_id % 3 * exposure_idx as int) as dx, cast(exposure_idx as int) as dy from (select distinct scene_id, exposure_idx from stack))"
add("cumulative_shifts", lambda s, d: brackets.cumulative_shifts(pair_shifts(s, d)), f"{MOVES} select scene_id, exposure_idx, dx, dy from sh")
add("apply_shifts", lambda s, d: r6(brackets.apply_shifts(views.stack(s, d), brackets.cumulative_shifts(pair_shifts(s, d))), *RGB), f"{MOVES}, mv as (select scene_id, exposure_idx, x-dx as x, y-dy as y, r, g, b from stack join sh using (scene_id, exposure_idx)) select a.scene_id, a.x, a.y, a.exposure_idx, {triple([f'coalesce(m.{c}, 0e0)' for c in RGB])} from stack a left join mv m on a.scene_id = m.scene_id and a.exposure_idx = m.exposure_idx and a.x = m.x and a.y = m.y")
add("output_names", lambda s, d: brackets.output_names(merge.assign_brackets(views.meta(s, d), 3), "drago", "png"), "a as (select *, cast(floor((row_number() over (partition by folder_id order by file)-1)/3) as int) as bracket from meta), n as (select folder_id, bracket, replace(min(file), '.tif', '') || '-' || replace(max(file), '.tif', '') || '_drago.png' as name from a group by 1, 2) select folder_id, bracket, name, lpad(cast(bracket+1 as varchar), cast(ceil(log10((count(*) over (partition by folder_id))+1)) as int), '0') as counter from n")


def presets(spark, sf_dir) -> dict[str, DataFrame]:
    saved = views.meta(spark, sf_dir).select("orientation", F.col("iso").alias("key"), F.concat(F.lit("iso "), F.coalesce("iso", F.lit(0.0)).cast("int").cast("string")).alias("comment"))
    return {tmo: saved.where(F.col("orientation") == o) for tmo, o in (("drago", 1), ("reinhard02", 3), ("ferwerda", 6))}


add("preset_catalogue", lambda s, d: brackets.preset_catalogue(presets(s, d)), "select distinct 'iso ' || cast(cast(coalesce(iso, 0e0) as int) as varchar) as comment, case orientation when 1 then 'drago' when 3 then 'reinhard02' else 'ferwerda' end as tmo from meta where orientation in (1, 3, 6)")

# Separable resize, visual adaptation
TAPS = lambda name, size, count: f"{name}a as (select frame_id, {size}, sc, unnest(range({count})) as o from lz), {name}b as (select *, (o+0.5e0)/sc-0.5e0 as c, least(sc, 1e0) as st from {name}a), {name}c as (select *, unnest(range(greatest(0, cast(floor(c-3e0/st) as bigint)+1), least({size}, cast(floor(c+3e0/st) as bigint)+1))) as t from {name}b), {name}d as (select *, st*(c-t) as z from {name}c), {name}e as (select frame_id, o, t, case when z*z < 1e-6 then 1e0 when abs(z) > 3e0 then 0e0 else 3e0*sin(pi()*z)*sin(pi()*z/3e0)/(pi()*z*pi()*z) end as w from {name}d), {name} as (select frame_id, o, t, w/sum(w) over (partition by frame_id, o) as w from {name}e)"
over_px("resize_lanczos", lambda p: levels.resize_lanczos(p, 10), f"lz as (select frame_id, max(x)+1 as w, max(y)+1 as h, cast(floor((max(y)+1)*10/(max(x)+1)) as int) as h2, 10e0/(max(x)+1) as sc from px group by 1), {TAPS('tv', 'h', 'h2')}, {TAPS('th', 'w', '10')}, lv as (select px.frame_id, x, o as y, {', '.join(f'sum(w*{c}) as {c}' for c in RGB)} from px join tv on tv.frame_id = px.frame_id and t = y group by 1, 2, 3) select lv.frame_id, cast(o as int) as x, cast(y as int) as y, {three('greatest(0e0, sum(w*$))')} from lv join th on th.frame_id = lv.frame_id and t = x group by 1, 2, 3")
CSG = lambda i: f"(12.9223e0*{i}/(pow(1e0/(5e0*{i}+1e0), 4e0)*{i}+0.171e0*pow(1e0-pow(1e0/(5e0*{i}+1e0), 4e0), 2e0)*cbrt({i})))"
RSG = lambda i: f"(2.5874e0*{i}/(19000e0*pow(1e0/(5e4*{i}+1e0), 2e0)*{i}+0.2615e0*pow(1e0-pow(1e0/(5e4*{i}+1e0), 2e0), 4e0)*sqrt(cbrt({i}))))"
MR = lambda i, s: f"(pow({i}, 0.73e0)/(pow({i}, 0.73e0)+pow({s}, 0.73e0)))"
over_px("tm_pattanaik", levels.tm_pattanaik, f"""{LUM}, v0 as (select frame_id, 5e0*exp(avg(ln(lum+2.3e-5))) as a from lm group by 1), v1 as (select frame_id, a, 2e6/(2e6+a) as bc, 0.04e0/(0.04e0+a) as br, {CSG('a')} as sc, {RSG('a')} as sr, {CSG('25e0')} as ds from v0),
v2 as (select *, bc*{MR('(a*5e0)', 'sc')}+br*{MR('(a*5e0)', 'sr')} as ws, bc*{MR('(a/6.4e0)', 'sc')}+br*{MR('(a/6.4e0)', 'sr')} as ks, {MR('125e0', 'ds')} as wd, {MR('(25e0/6.4e0)', 'ds')} as kd from v1),
v3 as (select *, case when ws > wd then ws when ks < kd then ks else 0e0 end as dx, case when ws > wd then wd when ks < kd then kd else 0e0 end as dz, case when ws > wd or ks < kd then least((wd-kd)/(ws-ks), 1e0) else 1e0 end as dy, (wd-kd)/log10(32e0) as sd from v2),
v4 as (select lm.*, v3.* exclude (frame_id), br*{MR('lum', 'sr')} as rr, bc*{MR('lum', 'sc')} as rc from lm join v3 using (frame_id)), v5 as (select *, greatest(0e0, least(0.9999999e0, (rr+rc-dx)*dy+dz)) as ra, bc*pow(sc, 0.73e0)*0.73e0*pow(lum, 0.73e0)/pow(pow(lum, 0.73e0)+pow(sc, 0.73e0), 2e0)/sd as co from v4)
select {PIX}, {three(f'least(greatest(ds/125e0*pow(ra/(1e0-ra), {1 / 0.73!r}e0)*(pow($/lum, co)*rc/(rr+rc)+rr/(rr+rc)), 0e0), 1e0)')} from v5""")  # fmt: skip

# I10, I14 whole
over_px("tm_pattanaik_local", extended.stencils.tm_pattanaik_local, f"""{extended.NEAR}, v0 as (select frame_id, 5e0*exp(avg(ln(lum+2.3e-5))) as a from lm group by 1), v1 as (select frame_id, a, 2e6/(2e6+a) as bc, 0.04e0/(0.04e0+a) as br, {CSG('a')} as sc, {RSG('a')} as sr, {CSG('25e0')} as ds from v0),
v2 as (select *, bc*{MR('(a*5e0)', 'sc')}+br*{MR('(a*5e0)', 'sr')} as ws, bc*{MR('(a/6.4e0)', 'sc')}+br*{MR('(a/6.4e0)', 'sr')} as ks, {MR('125e0', 'ds')} as wd, {MR('(25e0/6.4e0)', 'ds')} as kd from v1),
v3 as (select frame_id, ds, case when ws > wd then ws when ks < kd then ks else 0e0 end as dx, case when ws > wd then wd when ks < kd then kd else 0e0 end as dz, case when ws > wd or ks < kd then least((wd-kd)/(ws-ks), 1e0) else 1e0 end as dy, (wd-kd)/log10(32e0) as sd from v2),
vl as (select lm.*, coalesce(v, lm.lum) as la from lm left join ob using (frame_id, x, y)), vm as (select *, 2e6/(2e6+la) as bc, 0.04e0/(0.04e0+la) as br, {CSG('la')} as sc, {RSG('la')} as sr from vl),
v4 as (select vm.*, v3.* exclude (frame_id), br*{MR('lum', 'sr')} as rr, bc*{MR('lum', 'sc')} as rc from vm join v3 using (frame_id)), v5 as (select *, greatest(0e0, least(0.9999999e0, (rr+rc-dx)*dy+dz)) as ra, bc*pow(sc, 0.73e0)*0.73e0*pow(lum, 0.73e0)/pow(pow(lum, 0.73e0)+pow(sc, 0.73e0), 2e0)/sd as co from v4)
select {PIX}, {three(f'least(greatest(ds/125e0*pow(ra/(1e0-ra), {1 / 0.73!r}e0)*(pow($/lum, co)*rc/(rr+rc)+rr/(rr+rc)), 0e0), 1e0)')} from v5""")  # fmt: skip
REINHARD = lambda src: f"rl as (select *, {Y} as lum from {src}), rz as (select frame_id, exp(avg(ln(lum+1e-5))) as av, max(lum) as top from rl group by 1), rq as (select rl.*, lum*0.18e0/av as v, top*0.18e0/av as t from rl join rz using (frame_id)), rt as (select {PIX}, {', '.join(f'{c}*(v*(1e0+v/(t*t))/(1e0+v))/lum as {c}' for c in RGB)} from rq)"
DRAGO = f"dz as (select frame_id, max(g) as top, exp(avg(ln(g+1e-4))) as av from px group by 1), dq as (select px.*, g/av as w, top/av as t from px join dz using (frame_id)), dn as (select *, ln(w+1e0)/(ln(2e0+8e0*exp((ln(0.85e0)/ln(0.5e0))*(ln(w)-ln(t))))*log10(t+1e0)) as l from dq), dt as (select {PIX}, {', '.join(f'{c}*(case when g <> 0 then l/g else 0e0 end) as {c}' for c in RGB)} from dn)"
BYTE = lambda c: f"cast(floor(floor(least(greatest({c}, 0e0), 1e0)*255e0+0.5e0)/255e0*255e0+1e-9) as int)"
TURNED = ", ".join(f"pow(greatest({w}, 0e0), {1 / 1.2!r}e0) as {c}" for w, c in zip((WAVE("0e0"), WAVE("4e0"), WAVE("2e0")), RGB, strict=True))
over_px("render_auto", lambda p: render.render(p, "reinhard02", pregamma=1.1, postsaturation=0.8, postgamma=1.2, crop=(1, 1, 22, 20), auto=0.95, bits=32), f"""cp as (select frame_id, x-1 as x, y-1 as y, {', '.join(f'pow({c}, {1 / 1.1!r}e0) as {c}' for c in RGB)} from px where x >= 1 and x < 22 and y >= 1 and y < 20), {REINHARD('cp')}, {HSL_SQL.replace('/60e0', '').replace('from px', 'from rt')},
h4 as (select {PIX}, h, s*0.8e0 as s, l from h3), ft as (select {PIX}, {TURNED} from h4), au as (select frame_id, {', '.join(f'{BYTE(c)} as {c}' for c in RGB)} from ft), {AUTO(0.95)}, an as (select frame_id, min(xa)/255e0 as lo, max(xb)/255e0 as hi from ae group by 1)
select {PIX}, {three('least(greatest(($-lo)/(hi-lo), 0e0), 1e0)')} from ft join an using (frame_id)""")  # fmt: skip
add("render_batch", extended.render_presets, f"""{DRAGO}, {REINHARD('px')} select {PIX}, {', '.join(f'floor(least(greatest({c}, 0e0), 1e0)*65535e0+0.5e0) as {c}' for c in RGB)}, 'a' as preset from dt
union all select {PIX}, {', '.join(f"cast({BYTE(f'pow({c}, {1 / 1.5!r}e0)')} as double)" for c in RGB)}, 'b' from rt union all select {PIX}, {', '.join(f"cast({BYTE(f'pow({c}, {1 / 2.0!r}e0)')} as double)" for c in RGB)}, 'd' from dt""")  # fmt: skip
