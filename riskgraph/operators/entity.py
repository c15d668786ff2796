"""Entity statistics (card, e-mail, address pair, device) and the 52-column entity view."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.functions import scalar as S
from riskgraph.functions.quantiles import quantile_list, quantiles
from riskgraph.plans.hot import MIN_ROWS
from riskgraph.plans.lineage import cut, cut_all
from riskgraph.schema import (
    ADDR, ADDR_STATS, AMOUNT, CARD, CARD_STATS, DAY, DEVICE, DEVICE_STATS, EMAIL, EMAIL_STATS,
    EMAIL_TO, ENTITY_FEATURES, ID, PRODUCT, TARGET, TIME,
)

GLOBAL_DEFAULT = {"mean_amt": "amount_mean", "median_amt": "amount_mean", "fraud_rate": "fraud_rate"}


def with_entity_keys(df: DataFrame) -> DataFrame:
    """Add the typed entity keys ``_card, _email, _addr, _device`` (address nulls are -1)."""
    def have(c):
        return F.col(c) if c in df.columns else F.lit(None).cast("string")

    return df.withColumns({
        "_card": F.col(CARD),
        "_email": have(EMAIL),
        "_addr": S.address_key(have(ADDR[0]), have(ADDR[1])),
        "_device": S.device_key(have(DEVICE[0]), have(DEVICE[1])),
    })


def entity_stats(df: DataFrame, key: str, *, target: str = TARGET, amount: str = AMOUNT, extra=(),
                 max_group: int = MIN_ROWS, rows: int | None = None) -> DataFrame:
    """Per value of ``key``: amount mean, median, sample deviation, maximum, count, target rate.

    Null keys are left out.  Everything combines before the shuffle.  When no group can exceed
    ``max_group`` rows (``rows`` bounds it) the median is part of the same aggregation; otherwise
    it comes from :func:`quantiles`, which never holds a hot group in one task.  ``extra`` are
    further aggregates of the same pass.
    """
    a = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    small = rows is not None and rows <= max_group
    base = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.avg(a).alias("mean_amt"),
        F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("std_amt"),
        F.max(a).alias("max_amt"),
        F.count(F.lit(1)).alias("count"),
        F.avg(F.col(target).cast("double")).alias("fraud_rate"),
        *([F.percentile(a, 0.5).alias("median_amt")] if small else []),
        *extra,
    )
    if small:
        return base
    pairs = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_mk"), a.alias("_a"))
    med = quantiles(pairs, ["_mk"], "_a", [0.5], max_group=max_group, rows=rows).select(
        "_mk", F.col("q")[0].alias("median_amt"))
    return base.join(med, base["key"] == med["_mk"], "left").drop("_mk")


def distinct_per(df: DataFrame, key: str, values: dict[str, object]) -> DataFrame:
    """Distinct values per key, null counted as a value of its own, all counts from one pass.

    The (key, name, value) triples are made unique first, so a hot key is spread by its values.
    """
    items = F.array(*[F.struct(F.lit(n).alias("n"), v.cast("string").alias("v")) for n, v in values.items()])
    seen = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(items).alias("i")).select(
        "key", "i.n", "i.v").distinct()
    return seen.groupBy("key").agg(*[F.count_if(F.col("n") == n).alias(n) for n in values])


def activity(*, time: str = TIME) -> list:
    """Aggregates: days between first and last row, and rows per day (at least one day)."""
    days = (F.max(time) - F.min(time)) / DAY
    return [days.alias("days_active"), (F.count(F.lit(1)) / F.greatest(days, F.lit(1.0))).alias("txn_freq")]


def _flag_value(name: str, kind: str):
    """Numeric value of an M flag; T and F as text count as 1 and 0."""
    if kind != "string":
        return F.col(name)
    return F.when(F.col(name) == "T", 1.0).when(F.col(name) == "F", 0.0).otherwise(F.col(name).try_cast("double"))


def family_means(df: DataFrame) -> list:
    """Aggregates: means of C1, C13, C14, and the mean over the M flags of their means."""
    columns = df.columns
    m = [F.avg(_flag_value(c, kind)) for c, kind in df.dtypes if re.fullmatch(r"M\d+", c)]
    if m:
        seen = sum((x.isNotNull().cast("int") for x in m), F.lit(0))
        flag = F.when(seen > 0, sum((F.coalesce(x, F.lit(0.0)) for x in m), F.lit(0.0)) / seen)
    else:
        flag = F.max(F.lit(0.0))
    c = [(F.avg(n) if n in columns else F.max(F.lit(0.0))).alias(f"{n.lower()}_mean") for n in ("C1", "C13", "C14")]
    return [*c, flag.alias("m_flag_mean")]


def bin_risk(df: DataFrame, col: str, n_bins: int = 10, target: str = TARGET, **kw):
    """Target rate per quantile bin: (edges, rates); at most ``n_bins`` numbers each."""
    if col not in df.columns:
        return None
    edges = quantile_list(df, col, [i / n_bins for i in range(n_bins + 1)], **kw)
    if edges is None:
        return None
    edges = sorted(set(edges))
    if len(edges) < 2:
        return None
    rates = {
        r["b"]: r["y"] for r in df.filter(F.col(col).isNotNull())
        .groupBy(S.bin_index(F.col(col), edges).alias("b"))
        .agg(F.avg(F.col(target).cast("double")).alias("y")).collect()
    }
    return edges, [float(rates.get(b) or 0.0) for b in range(len(edges) - 1)]


def apply_bin_risk(value, risk, default: float):
    if risk is None:
        return F.lit(default)
    edges, rates = risk
    idx = S.bin_index(value, edges)
    out = F.when(value.isNull(), F.lit(default))
    for b, r in enumerate(rates):
        out = out.when(idx == b, F.lit(r))
    return out


@dataclass
class EntityModel:
    amount_mean: float
    amount_std: float
    fraud_rate: float
    id_01: tuple | None
    id_02: tuple | None
    v_cols: list[str]
    v_mean: list[float]
    v_std: list[float]
    cards: DataFrame = field(repr=False)
    emails: DataFrame = field(repr=False)
    addresses: DataFrame = field(repr=False)
    devices: DataFrame = field(repr=False)
    card_devices: DataFrame = field(repr=False)

    def lookup(self, df: DataFrame, key: str, stats: DataFrame, names, prefix: str) -> DataFrame:
        """Left join of one state table; a key without state gets the documented defaults.

        No broadcast hint: Spark decides by the table's size, and splits skewed keys otherwise.
        """
        st = stats.select(F.col("key").alias("_sk"), *[F.col(n).alias(f"_st_{n}") for n in names])
        j = df.join(st, df[key] == st["_sk"], "left")
        cols = {}
        for n in names:
            g = GLOBAL_DEFAULT.get(n)
            cols[f"{prefix}{n}"] = F.coalesce(
                F.col(f"_st_{n}"), F.lit(float(getattr(self, g)) if g else 0.0)
            )
        return j.withColumns(cols).drop("_sk", *[f"_st_{n}" for n in names])

    def transform(self, df: DataFrame) -> DataFrame:
        """The 52 entity and identity columns plus ``TransactionID``."""
        cols = set(df.columns)

        def col(c, kind="double"):
            return F.col(c) if c in cols else F.lit(None).cast(kind)

        x = with_entity_keys(df)
        card_extra = ("c1_mean", "c13_mean", "c14_mean", "m_flag_mean")
        known = self.cards.select("key", *CARD_STATS, *card_extra, F.lit(1).alias("seen"))
        x = self.lookup(x, "_card", known, [*CARD_STATS, *card_extra, "seen"], "feat_card_")
        x = self.lookup(x, "_email", self.emails, EMAIL_STATS, "feat_email_")
        x = self.lookup(x, "_addr", self.addresses, ADDR_STATS, "feat_addr_")
        x = self.lookup(x, "_device", self.devices, DEVICE_STATS, "feat_device_")
        pairs = self.card_devices.select(F.col("card").alias("_pc"), F.col("device").alias("_pd"))
        x = x.join(pairs, (x["_card"] == pairs["_pc"]) & (x["_device"] == pairs["_pd"]), "left")

        a = F.coalesce(F.col(AMOUNT).cast("double"), F.lit(0.0))
        os = S.os_flags(col(DEVICE[1], "string"))
        c_cols = [c for c in df.columns if re.fullmatch(r"C\d+", c)]
        isna = [c for c in df.columns if c.startswith("id_") and c.endswith("__isna")]
        proxy = [c for c in ("id_35", "id_36", "id_37", "id_38") if c in cols]
        z = [F.abs((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s)
             for c, m, s in zip(self.v_cols, self.v_mean, self.v_std, strict=True)]
        zero = F.lit(0.0)
        out = {
            "feat_c1_mean_card": F.coalesce("feat_card_c1_mean", zero),
            "feat_c13_mean_card": F.coalesce("feat_card_c13_mean", zero),
            "feat_c14_mean_card": F.coalesce("feat_card_c14_mean", zero),
            "feat_m_flag_mean_card": F.coalesce("feat_card_m_flag_mean", zero),
            "feat_c_total_per_txn": sum((F.coalesce(F.col(c).cast("double"), zero) for c in c_cols), zero),
            "feat_id_01_bin_risk": apply_bin_risk(col("id_01"), self.id_01, self.fraud_rate),
            "feat_id_02_bin_risk": apply_bin_risk(col("id_02"), self.id_02, self.fraud_rate),
            "feat_device_is_windows": os["windows"],
            "feat_device_is_ios": os["ios"],
            "feat_device_is_android": os["android"],
            "feat_device_is_mobile": S.flag(F.lower(col(DEVICE[0], "string")) == "mobile"),
            "feat_is_proxy_heuristic": F.greatest(
                F.lit(0).cast("tinyint"), F.lit(0).cast("tinyint"),
                *[S.flag(S.number(F.col(c)) > 0) for c in proxy]),
            "feat_email_mismatch": S.email_mismatch(col(EMAIL, "string"), col(EMAIL_TO, "string")),
            "feat_high_risk_tld": S.is_high_risk_tld(col(EMAIL, "string")),
            "feat_suspicious_hour": S.is_suspicious_hour(S.hour_of(F.coalesce(F.col(TIME), F.lit(0)))),
            "feat_identity_missing": S.flag(
                sum((F.col(c) for c in isna), F.lit(0)) > len(isna) / 2) if isna
                else F.lit(0).cast("tinyint"),
            "feat_new_device_for_card": S.flag((F.col("feat_card_seen") == 1) & F.col("_pc").isNull()),
            "feat_multi_card_on_device": S.flag(F.col("feat_device_n_cards") > 1),
            "feat_v_feature_zscore_max": F.greatest(*z, zero) if z else zero,
            "feat_v_feature_zscore_mean": sum(z, zero) / len(z) if z else zero,
            "feat_amt_outlier_flag": S.flag(a > self.amount_mean + 2.0 * self.amount_std),
        }
        return x.select(ID, *[out[c].alias(c) if c in out else F.col(c) for c in ENTITY_FEATURES])

    def globals(self) -> dict:
        return {k: getattr(self, k) for k in (
            "amount_mean", "amount_std", "fraud_rate", "id_01", "id_02", "v_cols", "v_mean", "v_std")}

    def tables(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in (
            "cards", "emails", "addresses", "devices", "card_devices")}

    @classmethod
    def restore(cls, spark: SparkSession, values: dict, tables: dict) -> EntityModel:
        return cls(**values, **tables)


def device_pairs(df: DataFrame) -> DataFrame:
    """Distinct (card, device) pairs."""
    return df.filter(F.col("_card").isNotNull()).select(
        F.col("_card").alias("card"), F.col("_device").alias("device")).distinct()


def card_table(x: DataFrame, **kw) -> DataFrame:
    values = {"unique_addr": F.col("_addr"), "unique_emails": F.col("_email"), "unique_devices": F.col("_device")}
    if PRODUCT in x.columns:
        values["unique_products"] = F.col(PRODUCT)
    div = distinct_per(x, "_card", values)
    if PRODUCT not in x.columns:
        div = div.withColumn("unique_products", F.lit(0))
    return entity_stats(x, "_card", extra=[*activity(), *family_means(x)], **kw).join(div, "key", "left")


def email_table(x: DataFrame, **kw) -> DataFrame:
    return entity_stats(x, "_email", **kw).join(distinct_per(x, "_email", {
        "unique_cards": F.col("_card"), "unique_addrs": F.col("_addr")}), "key", "left")


def shared_table(x: DataFrame, key: str, **kw) -> DataFrame:
    """Address or device statistics with the number of distinct cards."""
    return entity_stats(x, key, **kw).join(
        distinct_per(x, key, {"n_cards": F.col("_card")}), "key", "left")


def fit_entity(df: DataFrame, fit_filter=None, *, max_group: int = MIN_ROWS) -> EntityModel:
    """Learn all entity tables from ``df``, or only from its rows under ``fit_filter``."""
    if fit_filter is not None:
        df = df.filter(fit_filter)
    if TARGET not in df.columns:
        df = df.withColumn(TARGET, F.lit(0))
    x = with_entity_keys(df)
    v_cols = [c for c in df.columns if re.fullmatch(r"V\d+", c)]
    a = F.coalesce(F.col(AMOUNT).cast("double"), F.lit(0.0))
    g = x.agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("am"), F.stddev_pop(a).alias("asd"), F.avg(F.col(TARGET).cast("double")).alias("fr"),
        *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"m_{c}") for c in v_cols],
        *[F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"s_{c}") for c in v_cols],
    ).first()
    n = int(g["n"])
    kw = {"max_group": max_group, "rows": n}
    # All tables and both risk tables read these few columns, so they are written once.
    narrow = [c for c in x.columns if c in (AMOUNT, TIME, TARGET, PRODUCT, "C1", "C13", "C14", "id_01", "id_02")
              or c in ("_card", "_email", "_addr", "_device") or re.fullmatch(r"M\d+", c)]
    x = cut(x.select(*narrow), "entity_rows")
    tables = cut_all({
        "cards": card_table(x, **kw), "emails": email_table(x, **kw), "addresses": shared_table(x, "_addr", **kw),
        "devices": shared_table(x, "_device", **kw), "card_devices": device_pairs(x),
    })
    return EntityModel(
        amount_mean=float(g["am"] or 0.0), amount_std=float(g["asd"] or 0.0) or 1.0,
        fraud_rate=float(g["fr"] or 0.0),
        id_01=bin_risk(x, "id_01", **kw), id_02=bin_risk(x, "id_02", **kw),
        v_cols=v_cols, v_mean=[float(g[f"m_{c}"]) for c in v_cols],
        v_std=[float(g[f"s_{c}"]) or 1.0 for c in v_cols], **tables,
    )
