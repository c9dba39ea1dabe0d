"""How queries are registered with the SQL that checks them, and pieces of that SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..operators import pixels
from ..sources import views
from ..sources.views import CTE

RGB = pixels.RGB
NUDGE = 1.7320508075688772e-08  # more digits than any decimal of the tables: their values never end up on a tie
QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql if sql.lstrip().lower().startswith(("select", "with")) and "px as (" in sql else f"with {CTE} {sql}" if sql.lstrip().lower().startswith("select") else f"with {CTE}, {sql}"


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six digits, without negative zeros; the small addend keeps decimal ties off the edge on which engines differ."""
    return df.withColumns({c: F.round(F.col(c) + NUDGE, 6) + F.lit(0.0) for c in columns})


def s6(expression: str, name: str) -> str:
    return f"round({expression} + {NUDGE!r}, 6) + 0e0 as {name}"


def three(template: str) -> str:
    """The template for r, g and b, `$` being the channel."""
    return ", ".join(s6(template.replace("$", c), c) for c in RGB)


def over_px(name: str, f, sql: str | None) -> None:
    """A query from px to (frame_id, x, y, r, g, b)."""
    add(name, lambda spark, d: r6(f(views.px(spark, d)).select("frame_id", "x", "y", *RGB), *RGB), sql)


def mat(m, a: str, b: str, c: str) -> list[str]:
    return [f"({x!r}e0*{a} + {y!r}e0*{b} + {z!r}e0*{c})".replace("+ -", "- ") for x, y, z in m]


def triple(e: list[str]) -> str:
    return ", ".join(s6(x, c) for x, c in zip(e, RGB, strict=True))


def lin(c: str) -> str:
    return f"(case when {c} > 0.04045e0 then pow(({c}+0.055e0)/1.055e0, 2.4e0) when {c} >= -0.04045e0 then {c}/12.92e0 else -pow((0.055e0-{c})/1.055e0, 2.4e0) end)"


def srgb(c: str) -> str:
    return f"(case when {c} > 0.0031308e0 then 1.055e0*pow({c}, {1 / 2.4!r}e0)-0.055e0 when {c} >= -0.0031308e0 then {c}*12.92e0 else -0.945e0*pow(-{c}, {1 / 2.4!r}e0)-0.055e0 end)"


Y = mat(color.RGB_TO_XYZ, "r", "g", "b")[1]
XYZ = "q as (select frame_id, x, y, {} as xx, {} as yy, {} as zz from px)".format(*mat(color.RGB_TO_XYZ, "r", "g", "b"))
PIX = "frame_id, x, y"
KEYS = ("frame_id", "x", "y")
WX, WY = "(partition by frame_id, y order by x)", "(partition by frame_id, x order by y)"
LUM = f"lm as (select *, {Y} as lum from px)"
# Hue by the order of the channels: each of the six orders is one edge of the hexagon.
HSL_SQL = """h0 as (select frame_id, x, y, r/60e0 as r, g/60e0 as g, b/60e0 as b from px), h1 as (select *, greatest(r,g,b)-least(r,g,b) as d, (greatest(r,g,b)+least(r,g,b))/2e0 as l from h0),
h3 as (select *, case when l > 0 and d > 0 then d/(case when abs(1e0-abs(2e0*l-1e0)) < 1e-15 then 1e-15 else 1e0-abs(2e0*l-1e0) end) else 0e0 end as s, case when not (l > 0 and d > 0) then 0e0
when r >= g and g > b then (g-b)/d/6e0 when g > r and r >= b then (2e0-(r-b)/d)/6e0 when g > b and b >= r then (2e0+(b-r)/d)/6e0 when b >= g and g > r then (4e0-(g-r)/d)/6e0
when b > r and r >= g then (4e0+(r-g)/d)/6e0 else (6e0-(b-g)/d)/6e0 end as h from h1)"""
# Back by triangle waves between the least and the greatest channel; hue 1 is grey.
WAVE = lambda shift: f"case when l+s*least(l, 1e0-l) <= 0 or h >= 1 then l else l-s*least(l, 1e0-l)+2e0*s*least(l, 1e0-l)*least(greatest(abs(fmod(h*6e0+{shift}, 6e0)-3e0)-1e0, 0e0), 1e0) end"


def pct(name: str, src: str, c: str, keys: str, lo: float, hi: float) -> str:
    """SQL of interpolated histogram percentiles: `name` (keys, q_lo, q_hi)."""
    at = lambda share, q: f"greatest(lo, least(hi, max(case when cum-n < {share!r}e0*total and cum >= {share!r}e0*total then lo+(bin+({share!r}e0*total-(cum-n))/n)*wd end))) as {q}"
    return f"""{name}s as (select {keys}, min({c}) as lo, max({c}) as hi, count(*) as total from {src} group by {keys}), {name}w as (select *, case when hi > lo then (hi-lo)/(least(65536, total)-1) end as wd from {name}s),
{name}h as (select {keys}, lo, hi, total, wd, coalesce(floor(({c}-lo)/wd+1e-9), 0e0) as bin, count(*) as n from {src} join {name}w using ({keys}) group by all), {name}c as (select *, sum(n) over (partition by {keys} order by bin) as cum from {name}h),
{name} as (select {keys}, {at(lo, 'q_lo')}, {at(hi, 'q_hi')} from {name}c group by {keys}, lo, hi)"""
