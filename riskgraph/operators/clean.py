"""Cleaning: column families, missing values, categorical codes, clipping and scaling.

``fit_clean`` learns a :class:`CleanModel`; what it keeps is column names, a few numbers per
column, and one table of category codes.  ``transform`` always emits the fitted columns,
whatever the batch holds.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.functions.quantiles import quantile_list, quantiles
from riskgraph.plans.hot import MIN_ROWS
from riskgraph.plans.lineage import cut
from riskgraph.plans.scan import running_sums
from riskgraph.schema import AMOUNT, DEVICE, EMAILS, ID, PRODUCT, TARGET, TIME

LOG_AMOUNT = f"{AMOUNT}__log1p"


def families(schema: T.StructType, *, target: str = TARGET, time: str = TIME) -> dict[str, list[str]]:
    """Columns by family; metadata only.  Target, time and id belong to none."""
    kind = {f.name: isinstance(f.dataType, T.NumericType) for f in schema.fields}
    out: dict[str, list[str]] = {k: [] for k in (
        "v", "d", "c", "m", "id_numeric", "id_categorical", "email",
        "other_categorical", "other_numeric")}
    for name, numeric in kind.items():
        if name in (target, time, ID):
            continue
        head = re.fullmatch(r"([VDCM])\d+", name)
        if head:
            out[head.group(1).lower()].append(name)
        elif re.fullmatch(r"id[_-]?\d+", name):
            out["id_numeric" if numeric else "id_categorical"].append(name)
        elif name in EMAILS:
            out["email"].append(name)
        elif name in (*DEVICE, PRODUCT, "card4", "card6") or not numeric:
            out["other_categorical"].append(name)
        else:
            out["other_numeric"].append(name)
    return out


@dataclass(frozen=True)
class Fill:
    value: object
    flag: bool = False


@dataclass(frozen=True)
class CleanConfig:
    # Default fill per family.
    drop_above: float = 0.75
    fills: dict = field(default_factory=lambda: {
        "v": Fill(-999, True), "d": Fill(-1, True), "c": Fill(0), "m": Fill("missing"),
        "id_numeric": Fill(-999, True), "id_categorical": Fill("unknown"),
        "email": Fill("unknown"),
    })
    rest_numeric: float = -999
    rest_text: str = "unknown"
    scale: str = "standard"
    clip_quantile: float = 0.999
    log_amount: bool = True


def _missing(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    t = df.schema[name].dataType
    return (c.isNull() | F.isnan(c)) if isinstance(t, (T.DoubleType, T.FloatType)) else c.isNull()


def missing_fractions(df: DataFrame, cols=None) -> DataFrame:
    """``column, missing`` for all columns, from one aggregation over the data."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.avg(_missing(df, c).cast("int")).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in cols])
    return one.select(F.explode(pairs).alias("p")).select("p.column", "p.missing")


@dataclass
class CleanModel:
    config: CleanConfig
    dropped: list[str]
    fills: dict[str, Fill]
    categorical: list[str]
    clip: float | None = None
    numeric: list[str] = field(default_factory=list)
    center: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    codes: DataFrame | None = None

    def fill(self, df: DataFrame) -> DataFrame:
        """Drop sparse columns, flag and fill missing values; one projection."""
        cols, flags = [], []
        for name in df.columns:
            if name in self.dropped:
                continue
            f = self.fills.get(name)
            if f is None:
                cols.append(F.col(name))
                continue
            miss = _missing(df, name)
            keep = F.when(~miss, F.col(name)).otherwise(F.lit(f.value)).cast(df.schema[name].dataType)
            cols.append(keep.alias(name))
            if f.flag:
                flags.append(miss.cast("tinyint").alias(f"{name}__isna"))
        return df.select(*cols, *flags)

    def encode(self, df: DataFrame) -> DataFrame:
        """Replace categories by their codes; unseen and unknown values get 0."""
        for c in [c for c in self.categorical if c in df.columns]:
            m = self.codes.filter(F.col("column") == c).select(
                F.col("value").alias("_v"), F.col("code").alias("_code"))
            value = F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
            df = df.withColumn("_val", value).join(m, F.col("_val") == F.col("_v"), "left")
            df = df.withColumn(c, F.coalesce("_code", F.lit(0)).cast("int")).drop("_v", "_code", "_val")
        return df

    def unseen(self, df: DataFrame) -> DataFrame:
        """``column, n_unseen``: values without a code, per categorical column."""
        filled = self.fill(df)
        cols = [c for c in self.categorical if c in filled.columns]
        pairs = F.array(*[F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in cols])
        seen = filled.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(
            F.count(F.lit(1)).alias("n"))
        known = self.codes.select(
            F.col("column").alias("_c"), F.col("value").alias("_v"), F.lit(1).alias("_k"))
        j = seen.join(known, (seen["column"] == known["_c"]) & (seen["value"] == known["_v"]), "left")
        miss = F.when(F.col("_k").isNull() & (F.col("value") != "unknown"), F.col("n")).otherwise(0)
        return j.groupBy("column").agg(F.sum(miss).alias("n_unseen"))

    def amounts(self, df: DataFrame) -> DataFrame:
        """Log of the unclipped amount as a new column, then the clip."""
        if AMOUNT not in df.columns:
            return df
        a = F.col(AMOUNT)
        if self.config.log_amount:
            df = df.withColumn(LOG_AMOUNT, F.log1p(F.greatest(a, F.lit(0.0))))
        if self.clip is not None:
            df = df.withColumn(AMOUNT, F.least(a, F.lit(self.clip)))
        return df

    def scale(self, df: DataFrame) -> DataFrame:
        if self.config.scale == "none":
            return df
        return df.withColumns({
            c: (F.col(c).cast("double") - m) / s
            for c, m, s in zip(self.numeric, self.center, self.spread, strict=True) if c in df.columns
        })

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scale(self.amounts(self.encode(self.fill(df))))

    def globals(self) -> dict:
        d = {k: getattr(self, k) for k in ("dropped", "categorical", "clip", "numeric", "center", "spread")}
        d["config"] = asdict(self.config)
        d["fills"] = {k: asdict(v) for k, v in self.fills.items()}
        return d

    def tables(self) -> dict[str, DataFrame]:
        return {"codes": self.codes}

    @classmethod
    def restore(cls, spark: SparkSession, values: dict, tables: dict) -> CleanModel:
        cfg = dict(values.pop("config"))
        cfg["fills"] = {k: Fill(**v) for k, v in cfg["fills"].items()}
        fills = {k: Fill(**v) for k, v in values.pop("fills").items()}
        return cls(config=CleanConfig(**cfg), fills=fills, **values, **tables)


def category_codes(df: DataFrame, cols, *, time: str = TIME, ident: str = ID,
                   min_rows: int = MIN_ROWS) -> DataFrame:
    """``column, value, code``: codes 1.. in first-seen order per column; "unknown" has none.

    All columns in one pass: the pairs combine before the shuffle, so only distinct values of a
    task travel; numbering a very large vocabulary is split along first-seen time.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, code int")
    pairs = F.array(*[F.struct(
        F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value"))
        for c in cols])
    first = (
        df.select(F.col(time).alias("_t"), F.col(ident).alias("_id"), F.explode(pairs).alias("p"))
        .filter(F.col("p.value") != "unknown")
        .groupBy("p.column", "p.value").agg(F.min(F.struct("_t", "_id")).alias("_f"))
        .select("column", "value", F.col("_f._t").alias("_t"), F.col("_f._id").alias("_id"))
    )
    return running_sums(
        first, ["column"], "_t", {"code": F.lit(1)}, tie="_id", min_rows=min_rows
    ).select("column", "value", F.col("code").cast("int").alias("code"))


def fit_clean(df: DataFrame, config: CleanConfig | None = None, *, target: str = TARGET,
              time: str = TIME, min_rows: int = MIN_ROWS) -> CleanModel:
    cfg = config or CleanConfig()
    fam = families(df.schema, target=target, time=time)
    reserved = {target, time, ID}
    missing = {r["column"]: r["missing"] or 0.0 for r in missing_fractions(df).collect()}
    dropped = [c for c in fam["v"] if missing[c] > cfg.drop_above]
    fills = {c: cfg.fills[f] for f in cfg.fills for c in fam[f] if c not in dropped}
    for c in (*fam["other_numeric"], *fam["other_categorical"]):
        if missing[c] > 0:
            num = c in fam["other_numeric"]
            fills[c] = Fill(cfg.rest_numeric, True) if num else Fill(cfg.rest_text)
    cats = [*fam["m"], *fam["id_categorical"], *fam["email"], *fam["other_categorical"]]
    model = CleanModel(cfg, dropped, fills, cats)
    filled = model.fill(df)
    # Written once: every encoded column looks it up, and none goes back to the rows.
    model.codes = cut(category_codes(filled, cats, time=time, min_rows=min_rows), "codes")
    if AMOUNT in df.columns and 0.5 < cfg.clip_quantile < 1.0:
        model.clip = quantile_list(filled, AMOUNT, [cfg.clip_quantile], max_group=min_rows)[0]
    ready = model.amounts(filled)
    numeric = [
        f.name for f in ready.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in reserved
        and f.name not in cats and not f.name.endswith("__isna")
    ]
    center, spread = [], []
    if cfg.scale == "standard" and numeric:
        row = ready.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric],
                        *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
        center = [float(row[f"m_{c}"]) for c in numeric]
        spread = [float(row[f"s_{c}"]) or 1.0 for c in numeric]
    elif cfg.scale == "robust" and numeric:
        long = ready.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in numeric
        ])).alias("p")).select("p.c", "p.v")
        got = {r["c"]: r["q"] for r in quantiles(
            long, ["c"], "v", [0.25, 0.5, 0.75], max_group=min_rows).collect()}
        center = [float(got[c][1]) for c in numeric]
        spread = [float(got[c][2] - got[c][0]) or 1.0 for c in numeric]
    return replace(model, numeric=numeric, center=center, spread=spread)
