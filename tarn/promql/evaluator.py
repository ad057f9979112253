"""PromQL expressions as DataFrame plans.

A vector is a DataFrame of label columns, ``ts`` (the evaluation time in
microseconds) and ``value``; which columns are labels is known while planning,
so grouping and matching are column operations. A range function assigns each
sample to the evaluation times whose window holds it (arithmetic and explode,
no range join) and aggregates by series and time with partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, is_dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.promql import parser as P

LOOKBACK_MS = 300_000
DEFAULT_STEP_MS = 15_000
#: Range queries beyond this many points per series are refused.
MAX_POINTS = 30_000
NAME = "__name__"
EXEMPLARS = "exemplars"


@dataclass
class Vector:
    df: DataFrame
    labels: list[str]


@dataclass
class Scalar:
    value: Column | float


def _nan() -> Column:
    return F.lit(math.nan)


def align(start_ms: int, end_ms: int, step_ms: int = 0) -> tuple[int, int, int]:
    """Step and bounds of a range query: a rounded step, and bounds on its multiples for ten points or more."""
    step = step_ms or max(DEFAULT_STEP_MS, (end_ms - start_ms) // MAX_POINTS)
    if step > 60_000:
        step = step // 60_000 * 60_000
    elif step > 10_000:
        step = step // 5_000 * 5_000
    if (end_ms - start_ms) // step >= 10:
        start_ms, end_ms = start_ms // step * step, end_ms // step * step
    return start_ms, end_ms, step


def divide(a: Column, b: Column) -> Column:
    """Division of doubles with infinities and NaN."""
    by_zero = F.when(F.isnan(a) | (a == 0), _nan()).when((a > 0) == (F.signum(F.lit(1.0) / F.when(b == 0, F.lit(1.0)).otherwise(b)) > 0), F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def _low_nan(agg: Callable, c: Column, least: bool) -> Column:
    """min or max with NaN below every number (max) or ignored unless alone (min gives NaN where one is)."""
    plain = agg(F.when(~F.isnan(c), c))
    if least:
        return F.when(F.max(F.isnan(c).cast("int")) == 1, _nan()).otherwise(plain)
    return F.coalesce(plain, _nan())


def _quantile(c: Column, q: float) -> Column:
    if math.isnan(q):
        return _nan()
    if q < 0:
        return F.lit(-math.inf)
    if q > 1:
        return F.lit(math.inf)
    return F.percentile(c, F.lit(q))


def _selectors(node) -> list[P.Selector]:
    """The selectors of an expression, each once."""
    if isinstance(node, P.Selector):
        return [node]
    out: list[P.Selector] = []
    for part in node if isinstance(node, list) else vars(node).values() if is_dataclass(node) else ():
        out += [s for s in _selectors(part) if s not in out]
    return out


class Evaluator:
    """Evaluates expressions over metric tables of label columns, a time in microseconds and a value."""

    def __init__(self, spark: SparkSession, metrics: dict[str, DataFrame], start_ms: int, end_ms: int, step_ms: int, time_column: str = "_timestamp", value_column: str = "value", lookback_ms: int = LOOKBACK_MS, hidden: tuple[str, ...] = ("__hash__", EXEMPLARS)):
        if step_ms <= 0 or end_ms < start_ms:
            raise P.PromQLError("a range needs a positive step and an end after its start")
        if (end_ms - start_ms) // step_ms + 1 > MAX_POINTS:
            raise P.PromQLError(f"more than {MAX_POINTS} points per series")
        self.spark, self.metrics = spark, metrics
        self.start, self.step = start_ms * 1000, step_ms * 1000
        self.points = (end_ms - start_ms) // step_ms + 1
        self.end = self.start + (self.points - 1) * self.step
        self.time, self.value, self.hidden = time_column, value_column, hidden
        self.lookback = lookback_ms * 1000

    # Entry

    def query(self, text: str) -> DataFrame:
        out = self.eval(P.parse(text))
        if isinstance(out, Scalar):
            grid = self._grid()
            return grid.select("ts", self._number(out).alias("value"))
        return out.df.select(*out.labels, "ts", "value")

    def exemplars(self, text: str) -> DataFrame:
        """(series, ts, value, labels) of the exemplars between start and end, of every series that the expression's selectors take.

        A metric's table holds them in the column ``exemplars``, an array of
        structs (_timestamp, value, labels); a table without it has none. series
        is a map of the series' labels with the metric's name.
        """
        out = self.spark.createDataFrame([], "series map<string,string>, ts long, value double, labels map<string,string>")
        for s in _selectors(P.parse(text)):
            if EXEMPLARS not in self.metrics.get(s.name, out).columns:
                continue
            df, labels = self._matching(s)
            series = F.create_map(F.lit(NAME), F.lit(s.name), *[x for c in labels for x in (F.lit(c), F.col(c).cast("string"))])
            one = df.select(series.alias("series"), F.explode(EXEMPLARS).alias("e"))
            found = one.select("series", F.col("e._timestamp").cast("long").alias("ts"), F.col("e.value").cast("double").alias("value"), F.col("e.labels").alias("labels"))
            out = out.unionByName(found.filter(F.col("ts").between(self.start, self.end)))
        return out

    def _grid(self) -> DataFrame:
        return self.spark.range(self.points).select((F.lit(self.start) + F.col("id") * F.lit(self.step)).alias("ts"))

    @staticmethod
    def _number(s: Scalar) -> Column:
        return s.value if isinstance(s.value, Column) else F.lit(float(s.value))

    def eval(self, node):
        if isinstance(node, P.Number):
            return Scalar(node.value)
        if isinstance(node, P.Text):
            return node.value
        if isinstance(node, P.Selector):
            if node.range_ms is not None:
                raise P.PromQLError("a range vector needs a function")
            return self._instant(node)
        if isinstance(node, P.Unary):
            inner = self.eval(node.expr)
            if isinstance(inner, Scalar):
                return Scalar(-self._number(inner) if isinstance(inner.value, Column) else -inner.value)
            return self._map(inner, lambda v: -v)
        if isinstance(node, P.Aggregate):
            return self._aggregate(node)
        if isinstance(node, P.Binary):
            return self._binary(node)
        if isinstance(node, P.Call):
            return self._call(node)
        raise P.PromQLError(f"cannot evaluate {type(node).__name__} here")

    # Selectors

    def _series(self, s: P.Selector) -> Vector:
        """Samples that the selector's matchers take, without a time bound."""
        df, labels = self._matching(s)
        df = df.select(*[F.col(c) for c in labels], F.col(self.time).cast("long").alias("t"), F.col(self.value).cast("double").alias("v"))
        return Vector(df, labels)

    def _matching(self, s: P.Selector) -> tuple[DataFrame, list[str]]:
        """The rows of a metric's table that the selector's matchers take, and the labels."""
        if s.name not in self.metrics:
            raise P.PromQLError(f"unknown metric {s.name!r}")
        df = self.metrics[s.name]
        labels = [c for c in df.columns if c not in (self.time, self.value, NAME, *self.hidden)]
        condition = None
        for group in [s.matchers, *s.alternatives]:
            one = F.lit(True)
            for label, op, value in group:
                if label not in df.columns:
                    continue  # as if the label were not asked for
                c = F.coalesce(F.col(label).cast("string"), F.lit(""))
                test = c == value if op in ("=", "!=") else c.rlike(f"^(?:{value})$")
                one = one & (test if op in ("=", "=~") else ~test)
            condition = one if condition is None else condition | one
        return df.filter(condition), labels

    def _windows(self, samples: Vector, span: int, offset: int) -> DataFrame:
        """Each sample with the evaluation times whose window [ts - span, ts], both ends included, holds it."""
        t = F.col("t") + F.lit(offset)
        in_reach = samples.df.filter((F.col("t") >= self.start - span - offset) & (F.col("t") <= self.end - offset))
        first = F.greatest(F.lit(0).cast("long"), F.ceil((t - F.lit(self.start)) / F.lit(self.step)).cast("long"))
        last = F.least(F.lit(self.points - 1).cast("long"), F.floor((t + F.lit(span - self.start)) / F.lit(self.step)).cast("long"))
        held = in_reach.withColumn("__first", first).withColumn("__last", last).filter("__first <= __last")
        return held.withColumn("g", F.explode(F.sequence("__first", "__last"))).withColumn("ts", F.lit(self.start) + F.col("g") * F.lit(self.step)).drop("__first", "__last", "g")

    def _instant(self, s: P.Selector) -> Vector:
        samples = self._series(s)
        if s.at_ms is not None:
            at = s.at_ms * 1000 - s.offset_ms * 1000
            last = samples.df.filter((F.col("t") <= at) & (F.col("t") >= at - self.lookback)).groupBy(*samples.labels).agg(F.max_by("v", "t").alias("value"))
            return Vector(last.withColumn("ts", F.explode(F.sequence(F.lit(self.start), F.lit(self.end), F.lit(self.step)))), samples.labels)
        held = self._windows(samples, self.lookback, s.offset_ms * 1000)
        return Vector(held.groupBy(*samples.labels, "ts").agg(F.max_by("v", "t").alias("value")), samples.labels)

    def _range(self, node) -> tuple[Vector, int, int]:
        """Samples (labels, t, v), span and offset of a range selector or subquery."""
        if isinstance(node, P.Selector) and node.range_ms is not None:
            return self._series(node), node.range_ms * 1000, node.offset_ms * 1000
        if isinstance(node, P.Subquery):
            step = (node.step_ms or DEFAULT_STEP_MS) * 1000
            low = (self.start - node.range_ms * 1000 - node.offset_ms * 1000) // step * step
            inner = Evaluator(self.spark, self.metrics, low // 1000, self.end // 1000, step // 1000, self.time, self.value, self.lookback // 1000, self.hidden)
            v = inner.eval(node.expr)
            if isinstance(v, Scalar):
                v = Vector(inner._grid().select("ts", self._number(v).alias("value")), [])
            return Vector(v.df.withColumnsRenamed({"ts": "t", "value": "v"}), v.labels), node.range_ms * 1000, node.offset_ms * 1000
        raise P.PromQLError("a range vector is needed")

    # Functions

    def _over_time(self, node, agg: Callable[[int], Column], neighbours: bool = False, total: bool = False) -> Vector:
        """Aggregate the samples of every window; with ``neighbours`` each sample has its predecessor as pt, pv; with ``total`` its window's sum as __total.

        Sums of doubles depend on their order, so that of a window is taken in the order of time.
        """
        if isinstance(node, P.Selector) and node.at_ms is not None:
            # One window at a fixed time, whose result holds at every evaluation time.
            fixed = Evaluator(self.spark, self.metrics, node.at_ms, node.at_ms, 1, self.time, self.value, self.lookback // 1000, self.hidden)
            once = fixed._over_time(replace(node, at_ms=None), agg, neighbours, total)
            times = F.explode(F.sequence(F.lit(self.start), F.lit(self.end), F.lit(self.step)))
            return Vector(once.df.withColumn("ts", times), once.labels)
        samples, span, offset = self._range(node)
        df = samples.df
        if neighbours:
            order = Window.partitionBy(*samples.labels).orderBy("t") if samples.labels else Window.partitionBy(F.lit(1)).orderBy("t")
            reach = df.filter((F.col("t") >= self.start - span - offset) & (F.col("t") <= self.end - offset))
            df = reach.withColumn("pt", F.lag("t").over(order)).withColumn("pv", F.lag("v").over(order))
        held = self._windows(Vector(df, samples.labels), span, offset).withColumn("low", F.col("ts") - F.lit(span))
        if offset:
            held = held.withColumn("t", F.col("t") + F.lit(offset))
            held = held.withColumn("pt", F.col("pt") + F.lit(offset)) if neighbours else held
        if neighbours:
            inside = F.col("pt") >= F.col("low")
            held = held.withColumn("pv", F.when(inside, F.col("pv"))).withColumn("pt", F.when(inside, F.col("pt")))
        if total:
            whole = Window.partitionBy(*samples.labels, "ts").orderBy("t", "v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            held = held.withColumn("__total", F.sum("v").over(whole))
        out = held.groupBy(*samples.labels, "ts").agg(agg(span).alias("value")).filter(F.col("value").isNotNull())
        return Vector(out, samples.labels)

    @staticmethod
    def _extrapolated(counter: bool, rate: bool) -> Callable[[int], Column]:
        def agg(span: int) -> Column:
            t, v = F.col("t"), F.col("v")
            first_t, last_t, n = F.min(t), F.max(t), F.count(F.lit(1))
            first_v, last_v = F.min_by("v", "t"), F.max_by("v", "t")
            delta = last_v - first_v
            if counter:
                delta = delta + F.sum(F.when(F.col("pv") > v, F.col("pv")).otherwise(0.0))
            low, high = F.max("low"), F.max("ts")
            sampled = (last_t - first_t).cast("double")
            mean = F.try_divide(sampled, (n - 1).cast("double"))
            to_start, to_end = (first_t - low).cast("double"), (high - last_t).cast("double")
            limit = mean * 1.1
            to_start = F.when(to_start >= limit, mean / 2).otherwise(to_start)
            to_end = F.when(to_end >= limit, mean / 2).otherwise(to_end)
            if counter:
                # A counter does not start below zero.
                zero = F.when((delta > 0) & (first_v >= 0), sampled * F.try_divide(first_v, delta))
                to_start = F.when(zero < to_start, zero).otherwise(to_start)
            out = delta * F.try_divide(sampled + to_start + to_end, sampled)
            out = out / F.lit(span / 1e6) if rate else out
            return F.when((n >= 2) & (sampled > 0), out)

        return agg

    @staticmethod
    def _regression(at: Callable[[Column, Column], Column]) -> Callable[[int], Column]:
        """at(slope per second, value of the line at the evaluation time) from the samples of a window."""

        def agg(span: int) -> Column:
            x = (F.col("t") - F.col("ts")).cast("double") / 1e6
            n = F.count(F.lit(1))
            # A line through equal values is flat, whatever rounding would say.
            flat = F.max("v") == F.min("v")
            slope = F.when(flat, 0.0).otherwise(F.regr_slope(F.col("v"), x))
            level = F.when(flat, F.max("v")).otherwise(F.regr_intercept(F.col("v"), x))
            return F.when(n >= 2, at(slope, level))

        return agg

    def _call(self, node: P.Call):
        name, args = node.name, node.args
        v, pv, t = F.col("v"), F.col("pv"), F.col("t")
        simple: dict[str, Callable[[int], Column]] = {
            "avg_over_time": lambda s: F.avg(v),
            "sum_over_time": lambda s: F.max("__total"),
            "count_over_time": lambda s: F.count(F.lit(1)).cast("double"),
            "min_over_time": lambda s: _low_nan(F.min, v, True),
            "max_over_time": lambda s: _low_nan(F.max, v, False),
            "last_over_time": lambda s: F.max_by("v", "t"),
            "present_over_time": lambda s: F.lit(1.0) * F.max(F.lit(1)),
            "stddev_over_time": lambda s: F.stddev_pop(v),
            "stdvar_over_time": lambda s: F.var_pop(v),
            "deriv": self._regression(lambda slope, level: slope),
        }
        paired: dict[str, Callable[[int], Column]] = {
            "rate": self._extrapolated(True, True),
            "increase": self._extrapolated(True, False),
            "delta": self._extrapolated(False, False),
            "changes": lambda s: F.sum(F.when(pv.isNotNull() & (pv != v) & ~(F.isnan(pv) & F.isnan(v)), 1.0).otherwise(0.0)),
            "resets": lambda s: F.sum(F.when(pv > v, 1.0).otherwise(0.0)),
            "idelta": lambda s: F.max_by(v - pv, t),
            "irate": lambda s: F.max_by(F.when(t == F.col("pt"), 0.0).otherwise(F.try_divide(F.when(v < pv, v).otherwise(v - pv), (t - F.col("pt")).cast("double") / 1e6)), t),
        }
        if name in simple:
            return self._over_time(args[0], simple[name], total=name == "sum_over_time")
        if name in paired:
            return self._over_time(args[0], paired[name], neighbours=True)
        if name == "quantile_over_time":
            q = self._constant(args[0])
            return self._over_time(args[1], lambda s: _quantile(v, q))
        if name == "predict_linear":
            ahead = self._constant(args[1])
            return self._over_time(args[0], self._regression(lambda slope, level: level + slope * F.lit(ahead)))
        if name in ("holt_winters", "double_exponential_smoothing"):
            return self._over_time(args[0], self._smoothing(self._constant(args[1]), self._constant(args[2])))
        if name == "absent_over_time":
            present = self._over_time(args[0], lambda s: F.count(F.lit(1)).cast("double"))
            return self._absent(present, args[0])
        if name == "absent":
            return self._absent(self._as_vector(self.eval(args[0])), args[0])
        if name in ("time", "pi"):
            return Scalar(F.col("ts") / 1e6 if name == "time" else math.pi)
        if name == "vector":
            return Vector(self._grid().select("ts", self._number(self.eval(args[0])).alias("value")), [])
        if name == "scalar":
            return self._scalar(self._as_vector(self.eval(args[0])))
        if name in ("sort", "sort_desc"):
            vec = self._as_vector(self.eval(args[0]))
            return Vector(vec.df.orderBy(F.col("value").asc() if name == "sort" else F.col("value").desc(), *vec.labels), vec.labels)
        if name == "timestamp":
            return self._timestamp(args[0])
        if name in ("label_replace", "label_join"):
            return self._relabel(name, args)
        if name == "histogram_quantile":
            return self._histogram_quantile(self._number(self.eval(args[0])), self._as_vector(self.eval(args[1])))
        if name in ("clamp", "clamp_min", "clamp_max"):
            bounds = [self._number(self.eval(a)) for a in args[1:]]
            low = bounds[0] if name != "clamp_max" else None
            high = bounds[-1] if name != "clamp_min" else None
            vec = self._as_vector(self.eval(args[0]))
            if name == "clamp":
                vec = Vector(vec.df.filter(low <= high), vec.labels)
            return self._map(vec, lambda x: F.when(F.isnan(x), x).otherwise(F.greatest(low, F.least(high, x)) if name == "clamp" else F.greatest(low, x) if high is None else F.least(high, x)))
        if name in _MATH:
            return self._map(self._as_vector(self.eval(args[0])), _MATH[name])
        if name in _CALENDAR:
            vec = self._as_vector(self.eval(args[0])) if args else Vector(self._grid().withColumn("value", F.col("ts") / 1e6), [])
            return self._map(vec, lambda x: _CALENDAR[name](F.timestamp_micros((x * 1e6).cast("long"))).cast("double"))
        raise P.PromQLError(f"unknown function {name!r}")

    def _constant(self, node) -> float:
        got = self.eval(node)
        if not isinstance(got, Scalar) or isinstance(got.value, Column):
            raise P.PromQLError("a number is needed")
        return float(got.value)

    def _as_vector(self, got) -> Vector:
        if isinstance(got, Scalar):
            return Vector(self._grid().select("ts", self._number(got).alias("value")), [])
        return got

    @staticmethod
    def _map(vec: Vector, f: Callable[[Column], Column]) -> Vector:
        return Vector(vec.df.withColumn("value", f(F.col("value"))), vec.labels)

    @staticmethod
    def _smoothing(sf: float, tf: float) -> Callable[[int], Column]:
        """Double exponential smoothing of the window's samples in time order."""
        if not (0 < sf < 1 and 0 < tf < 1):
            raise P.PromQLError("smoothing and trend factors lie between 0 and 1")

        def agg(span: int) -> Column:
            values = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"])
            first, second = F.try_element_at(values, F.lit(1)), F.try_element_at(values, F.lit(2))
            begin = F.struct(first.alias("s"), (second - first).alias("b"), F.lit(True).alias("first"))

            def step(a: Column, x: Column) -> Column:
                trend = F.when(a["first"], a["b"]).otherwise(a["b"])
                s = F.lit(sf) * x + F.lit(1 - sf) * (a["s"] + trend)
                return F.struct(s.alias("s"), (F.lit(tf) * (s - a["s"]) + F.lit(1 - tf) * trend).alias("b"), F.lit(False).alias("first"))

            folded = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), begin, step, lambda a: a["s"])
            return F.when(F.count(F.lit(1)) >= 2, folded)

        return agg

    def _absent(self, vec: Vector, node) -> Vector:
        """1 at the evaluation times at which no series has a sample, with the labels that equality matchers name."""
        base = node.expr if isinstance(node, P.Subquery) else node
        fixed = {label: value for label, op, value in base.matchers if op == "="} if isinstance(base, P.Selector) else {}
        missing = self._grid().join(vec.df.select("ts").distinct(), "ts", "left_anti")
        return Vector(missing.select(*[F.lit(v).alias(k) for k, v in fixed.items()], "ts", F.lit(1.0).alias("value")), list(fixed))

    def _scalar(self, vec: Vector) -> Scalar | Vector:
        """A vector without labels: the value where there is exactly one series, else NaN."""
        one = vec.df.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("x"))
        df = self._grid().join(one, "ts", "left").select("ts", F.when(F.col("n") == 1, F.col("x")).otherwise(_nan()).alias("value"))
        return Vector(df, [])

    def _timestamp(self, node) -> Vector:
        if not isinstance(node, P.Selector):
            return self._map(self._as_vector(self.eval(node)), lambda x: F.col("ts") / 1e6)
        samples = self._series(node)
        held = self._windows(samples, self.lookback, node.offset_ms * 1000)
        return Vector(held.groupBy(*samples.labels, "ts").agg((F.max("t") / 1e6).alias("value")), samples.labels)

    def _relabel(self, name: str, args: list) -> Vector:
        vec = self._as_vector(self.eval(args[0]))
        texts = [self.eval(a) for a in args[1:]]

        def label(n: str) -> Column:
            return F.coalesce(F.col(n).cast("string"), F.lit("")) if n in vec.labels else F.lit("")

        target = texts[0]
        if name == "label_join":
            new = F.concat_ws(texts[1], *[label(s) for s in texts[2:]]) if texts[2:] else F.lit("")
        else:
            _, replacement, source, pattern = texts
            whole = f"^(?:{pattern})$"
            old = label(target)
            new = F.when(label(source).rlike(whole), F.regexp_replace(label(source), F.lit(whole), F.lit(replacement))).otherwise(old)
        df = vec.df.withColumn(target, F.nullif(new, F.lit("")))
        return Vector(df, vec.labels if target in vec.labels else [*vec.labels, target])

    def _histogram_quantile(self, q: Column, vec: Vector) -> Vector:
        if "le" not in vec.labels:
            return Vector(vec.df.filter(F.lit(False)), vec.labels)
        labels = [c for c in vec.labels if c != "le"]
        le = F.when(F.lower(F.col("le")).isin("+inf", "inf"), F.lit(math.inf)).otherwise(F.col("le").try_cast("double"))
        rows = vec.df.withColumn("le", le).filter("le IS NOT NULL").withColumn("__q", q)
        # Counts of equal bounds add up; then each bucket is at least the one before.
        merged = rows.groupBy(*labels, "ts", "le").agg(F.sum("value").alias("value"), F.max("__q").alias("q"))
        grouped = merged.groupBy(*labels, "ts").agg(F.array_sort(F.collect_list(F.struct("le", "value"))).alias("b"), F.max("q").alias("q"))
        grouped = grouped.filter((F.size("b") >= 2) & (F.element_at("b", -1)["le"] == math.inf))
        rising = F.aggregate(
            "b", F.array().cast("array<struct<le:double,value:double>>"),
            lambda a, x: F.concat(a, F.array(F.struct(x["le"].alias("le"), F.greatest(x["value"], F.coalesce(F.try_element_at(a, F.lit(-1))["value"], x["value"])).alias("value")))),
        )
        grouped = grouped.withColumn("b", rising).withColumn("total", F.element_at("b", -1)["value"]).withColumn("rank", F.col("q") * F.col("total"))
        at = F.size(F.filter("b", lambda x: x["value"] < F.col("rank")))
        grouped = grouped.withColumn("i", F.least(at, F.size("b") - 1))
        here, before = F.get("b", F.col("i")), F.get("b", F.col("i") - 1)
        low = F.when(F.col("i") > 0, before["le"]).otherwise(0.0)
        below = F.when(F.col("i") > 0, before["value"]).otherwise(0.0)
        inner = low + (here["le"] - low) * F.try_divide(F.col("rank") - below, here["value"] - below)
        value = (
            F.when(F.col("total") == 0, _nan()).when(F.isnan("q"), _nan()).when(F.col("q") < 0, F.lit(-math.inf)).when(F.col("q") > 1, F.lit(math.inf))
            .when(F.col("i") == F.size("b") - 1, F.get("b", F.size("b") - 2)["le"])
            .when((F.col("i") == 0) & (here["le"] <= 0), here["le"]).otherwise(F.coalesce(inner, low))
        )
        return Vector(grouped.select(*labels, "ts", value.alias("value")), labels)

    # Aggregations

    def _aggregate(self, node: P.Aggregate) -> Vector:
        vec = self._as_vector(self.eval(node.expr))
        if node.without:
            labels = [c for c in vec.labels if c not in node.labels]
        else:
            labels = [c for c in node.labels if c in vec.labels]
        v = F.col("value")
        if node.name in ("topk", "bottomk"):
            k = int(self._constant(node.param))
            key = F.when(F.isnan(v), F.lit(-math.inf) if node.name == "topk" else F.lit(math.inf)).otherwise(v)
            order = Window.partitionBy(*labels, "ts").orderBy(key.desc() if node.name == "topk" else key.asc(), *[F.col(c).asc_nulls_first() for c in vec.labels])
            df = vec.df.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r")
            return Vector(df, vec.labels)
        if node.name == "count_values":
            target = self.eval(node.param)
            text = F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(v.cast("string"))
            df = vec.df.withColumn(target, text).groupBy(*[c for c in labels if c != target], target, "ts").agg(F.count(F.lit(1)).cast("double").alias("value"))
            return Vector(df, [*[c for c in labels if c != target], target])
        q = self._constant(node.param) if node.param is not None else 0.0
        aggs = {
            "sum": F.sum(v), "avg": F.avg(v), "min": F.coalesce(F.min(F.when(~F.isnan(v), v)), _nan()),
            "max": F.coalesce(F.max(F.when(~F.isnan(v), v)), _nan()), "count": F.count(F.lit(1)).cast("double"), "group": F.max(F.lit(1.0)),
            "stddev": F.stddev_pop(v), "stdvar": F.var_pop(v), "quantile": _quantile(v, q),
        }
        return Vector(vec.df.groupBy(*labels, "ts").agg(aggs[node.name].alias("value")), labels)

    # Operators

    def _binary(self, node: P.Binary):
        left, right = self.eval(node.left), self.eval(node.right)
        compare = node.op in P.COMPARISONS
        if isinstance(left, Scalar) and isinstance(right, Scalar):
            if compare and not node.bool_:
                raise P.PromQLError("a comparison of scalars needs bool")
            if not isinstance(left.value, Column) and not isinstance(right.value, Column) and node.op in "+-*":
                a, b = float(left.value), float(right.value)
                return Scalar(a + b if node.op == "+" else a - b if node.op == "-" else a * b)
            return Scalar(_apply(node.op, self._number(left), self._number(right)))
        if isinstance(left, Scalar) or isinstance(right, Scalar):
            vec, scalar = (right, left) if isinstance(left, Scalar) else (left, right)
            a, b = (self._number(scalar), F.col("value")) if isinstance(left, Scalar) else (F.col("value"), self._number(scalar))
            if compare and not node.bool_:
                return Vector(vec.df.filter(_apply(node.op, a, b) == 1.0), vec.labels)
            return self._map(vec, lambda _: _apply(node.op, a, b))
        return self._vectors(node, left, right)

    def _vectors(self, node: P.Binary, left: Vector, right: Vector) -> Vector:
        every = list(dict.fromkeys([*left.labels, *right.labels]))
        match = list(node.on) if node.on is not None else [c for c in every if c not in (node.ignoring or [])]

        def keyed(vec: Vector) -> DataFrame:
            keys = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in vec.labels else F.lit("")).alias(f"__m{i}") for i, c in enumerate(match)]
            return vec.df.select("*", *keys)

        on = [f"__m{i}" for i in range(len(match))] + ["ts"]
        a, b = keyed(left), keyed(right)
        if node.op in P.SET_OPERATORS:
            if node.op == "and":
                return Vector(a.join(b.select(*on).distinct(), on, "left_semi").drop(*on[:-1]), left.labels)
            if node.op == "unless":
                return Vector(a.join(b.select(*on).distinct(), on, "left_anti").drop(*on[:-1]), left.labels)
            extra = b.join(a.select(*on).distinct(), on, "left_anti").drop(*on[:-1])
            return Vector(left.df.unionByName(extra, allowMissingColumns=True), every)
        many, one = (right, left) if node.group == "group_right" else (left, right)
        m, o = (b, a) if node.group == "group_right" else (a, b)
        include = [c for c in node.include if c in one.labels]
        o = o.select(*on, F.col("value").alias("__other"), *[F.col(c).alias(f"__in_{c}") for c in include])
        # More than one series on the "one" side of a match has no defined result.
        grouped = o.groupBy(*on).agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("many-to-many matching"))).otherwise(F.first("__other")).alias("__other"), *[F.first(f"__in_{c}").alias(f"__in_{c}") for c in include])
        joined = m.join(grouped, on)
        x, y = F.col("value"), F.col("__other")
        a_, b_ = (y, x) if node.group == "group_right" else (x, y)
        result = _apply(node.op, a_, b_)
        if node.op in P.COMPARISONS and not node.bool_:
            joined = joined.filter(result == 1.0).withColumn("__v", a_)
        else:
            joined = joined.withColumn("__v", result)
        if node.group:
            labels = list(dict.fromkeys([*many.labels, *include]))
            columns = [F.col(f"__in_{c}").alias(c) if c in include else F.col(c) for c in labels]
        else:
            labels = [c for c in left.labels if c in match] if node.on is not None or node.ignoring is not None else left.labels
            columns = [F.col(c) for c in labels]
        return Vector(joined.select(*columns, "ts", F.col("__v").alias("value")), labels)


def _apply(op: str, a: Column, b: Column) -> Column:
    if op in P.COMPARISONS:
        nan = F.isnan(a) | F.isnan(b)
        test = {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
        return F.when(nan, F.lit(1.0 if op == "!=" else 0.0)).otherwise(test.cast("double"))
    if op == "/":
        return divide(a, b)
    if op == "%":
        return F.when(b == 0, _nan()).otherwise(F.try_mod(a, b))
    if op == "^":
        return F.pow(a, b)
    if op == "atan2":
        return F.atan2(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(F.isnan(x) | (x < 0), _nan()).when(x == 0, F.lit(-math.inf)).otherwise(f(x))


_MATH: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "ceil": lambda x: F.when(F.isnan(x) | (F.abs(x) == math.inf), x).otherwise(F.ceil(x).cast("double")),
    "floor": lambda x: F.when(F.isnan(x) | (F.abs(x) == math.inf), x).otherwise(F.floor(x).cast("double")),
    "round": lambda x: F.when(F.isnan(x) | (F.abs(x) == math.inf), x).otherwise(F.signum(x) * F.floor(F.abs(x) + 0.5)),
    "exp": F.exp,
    "sqrt": F.sqrt,
    "sgn": lambda x: F.when(F.isnan(x), x).otherwise(F.signum(x)),
    "ln": _log(F.log),
    "log2": _log(F.log2),
    "log10": _log(F.log10),
}
_CALENDAR: dict[str, Callable[[Column], Column]] = {
    "minute": F.minute,
    "hour": F.hour,
    "day_of_week": lambda t: F.dayofweek(t) - 1,
    "day_of_month": F.dayofmonth,
    "day_of_year": F.dayofyear,
    "days_in_month": lambda t: F.dayofmonth(F.last_day(t)),
    "month": F.month,
    "year": F.year,
}
