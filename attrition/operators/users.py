"""The per-user table and its correlations.

``user_features`` is one ``groupBy(userId)`` over the events, distinct counts
from merged bit sets (``functions.bitset``) and two position statistics that
need each user's event order (computed with the bucketed sequence numbering of
``functions.sequence``, so a hot user is not one task). All per-user tables are keyed and partitioned by ``userId``, so
the final joins are co-partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.config import BROWSER_PATTERN, OS_PATTERN, PAGES
from attrition.functions.bitset import bit_of, known_bit, merge_sets, row_size, word_of
from attrition.functions.expr import floor_days, gender_code, token_bit
from attrition.functions.sequence import key_tag, sequence_view, tagged_order_key

USER_COLUMNS = [
    "gender_code",
    "account_age_days",
    "total_events",
    "total_sessions",
    "unique_pages",
    "unique_days_active",
    "events_per_session",
    "total_hearing_time",
    "mean_hearing_time",
    "hearing_time_variance",
    "hearing_time_change_rate",
    "unique_user_agents",
    "unique_browsers",
    "unique_os",
    "avg_hour_active",
    "most_common_day",
    "avg_day_of_month",
    "days_since_last_activity",
    "activity_change_rate",
    "paid_event_share",
    "time_to_churn_days",
    "is_churned_user",
]
TARGET = "is_churned_user"


def position_thirds(ev: DataFrame, value: str = "length") -> DataFrame:
    """Relative change between the mean of the first and the last
    ``n // 3`` non-null values of a user (time order); null if ``n < 3`` or
    the first mean is 0."""
    seq = sequence_view(ev.filter(F.col(value).isNotNull()).select("event_seq", "userId", "datetime", value), "userId")
    k = F.floor(F.col("n_part") / 3)
    agg = seq.groupBy("userId").agg(
        F.max("n_part").alias("_n"),
        F.avg(F.when(F.col("rn") <= k, F.col(value))).alias("_start"),
        F.avg(F.when(F.col("rn") > F.col("n_part") - k, F.col(value))).alias("_end"),
    )
    ok = (F.col("_n") >= 3) & (F.col("_start") != 0)
    return agg.select("userId", F.when(ok, (F.col("_end") - F.col("_start")) / F.col("_start")).alias(f"{value}_thirds_change"))


def position_halves(ev: DataFrame) -> DataFrame:
    """Relative change of events per active date between the first and the
    second half of a user's events (time order); null if fewer than 4."""
    seq = sequence_view(ev.select("event_seq", "userId", "datetime", "date"), "userId")
    mid = F.floor(F.col("n_part") / 2)
    first, second = F.col("rn") <= mid, F.col("rn") > mid
    d = F.col("date")
    agg = seq.groupBy("userId").agg(
        F.max("n_part").alias("_n"),
        F.try_divide(F.count(F.when(first, d)).cast("double"), F.count_distinct(F.when(first, d))).alias("_r1"),
        F.try_divide(F.count(F.when(second, d)).cast("double"), F.count_distinct(F.when(second, d))).alias("_r2"),
    )
    ok = (F.col("_n") >= 4) & (F.col("_r1") != 0)
    return agg.select("userId", F.when(ok, (F.col("_r2") - F.col("_r1")) / F.col("_r1")).alias("activity_change_rate"))


def user_distincts(ev: DataFrame) -> DataFrame:
    """``userId, total_sessions, unique_pages, unique_user_agents`` (longs, nulls not
    counted) per non-null user.

    Events are first reduced, before any shuffle, to one row for each (user, word of
    session ids, agent), with bits for sessions and known pages; a page outside the
    list has a row of its own. Only these rows are dealt out by what they count, where
    three distinct counts side by side would copy every event four times."""
    i = F.col("sessionId").cast("long")
    known = known_bit("page", PAGES)
    reduced = (
        ev.filter(F.col("userId").isNotNull())
        .select("userId", "userAgent", word_of(i).alias("_word"), bit_of(i).alias("_session"), known.alias("_page"),
                F.when(known.isNull(), F.col("page")).alias("_other_page"))
        .groupBy("userId", "_word", "userAgent", "_other_page")
        .agg(F.bit_or("_session").alias("_session"), F.bit_or("_page").alias("_page"))
    )

    def counted(kind: int, word: Column, other: Column, mask: Column) -> Column:
        return F.struct(F.lit(kind).alias("_kind"), word.alias("_word"), other.alias("_other"), mask.alias("_mask"))

    no_id, no_text = F.lit(None).cast("long"), F.lit(None).cast("string")
    rows = F.array(
        counted(0, F.col("_word"), no_text, F.col("_session")),
        counted(1, no_id, F.col("_other_page"), F.col("_page")),
        counted(2, no_id, F.col("userAgent"), no_id),
    )
    sets = merge_sets(reduced.select("userId", F.inline(rows)), ["userId", "_kind"])
    names = ["total_sessions", "unique_pages", "unique_user_agents"]
    return sets.groupBy("userId").agg(*[F.sum(F.when(F.col("_kind") == k, row_size())).alias(n) for k, n in enumerate(names)])


def user_features(ev: DataFrame) -> DataFrame:
    """22 columns per non-null user (all doubles), ``userId`` first.

    One skew-safe sequence view of the user's events (positions, previous /
    next level and date, running count of non-null lengths) feeds one
    ``groupBy(userId)`` that computes every column, the first churn time
    included, but for the distinct counts (``user_distincts``)."""
    from attrition.operators.churn import is_churn_coded as is_churn
    from attrition.operators.churn import with_level_code_neighbours

    users = ev.select(
        "event_seq", "userId", "sessionId", "datetime", "date", "registration_datetime", "page", "level", "gender", "length", "userAgent"
    )
    # first row by time: a decimal order key (hash aggregate, not a struct);
    # its tag carries the gender code + 1
    okey = tagged_order_key(gender_code("gender") + F.lit(1))
    dataset_end = ev.select(F.max("datetime")).scalar()
    seq = with_level_code_neighbours(users, ("date",), counters={"len": F.col("length").isNotNull()}, keep_level=True)
    d, rn = F.col("date"), F.col("rn")
    mid = F.floor(F.col("n_part") / 2)
    k = F.floor(F.col("len_total") / 3)
    has_len = F.col("length").isNotNull()
    new_day = d.isNotNull() & (F.col("prev_date").isNull() | (F.col("prev_date") != d))
    wd = F.weekday("datetime")
    base = seq.groupBy("userId").agg(
        F.min(okey).alias("_first_key"),
        F.min_by("registration_datetime", okey).alias("_reg"),
        F.min("datetime").alias("_first"),
        F.max("datetime").alias("_last"),
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(new_day).alias("unique_days_active"),
        F.sum("length").alias("total_hearing_time"),
        F.avg("length").alias("mean_hearing_time"),
        F.var_samp("length").alias("hearing_time_variance"),
        # a handful of tokens each: bits instead of distinct counts
        F.bit_count(F.bit_or(token_bit("userAgent", BROWSER_PATTERN))).alias("unique_browsers"),
        F.bit_count(F.bit_or(token_bit("userAgent", OS_PATTERN))).alias("unique_os"),
        F.avg(F.hour("datetime")).alias("avg_hour_active"),
        # the weekday mode as seven counts (ties -> lowest day, nulls ignored)
        *[F.count_if(wd == d).alias(f"_wd{d}") for d in range(7)],
        F.avg(F.dayofmonth("datetime")).alias("avg_day_of_month"),
        F.avg(F.coalesce(F.col("level") == "paid", F.lit(False)).cast("double")).alias("paid_event_share"),
        # position statistics (thirds of non-null lengths, halves of events)
        F.max("n_part").alias("_n"),
        F.max("len_total").alias("_nl"),
        F.avg(F.when(has_len & (F.col("len_rn") <= k), F.col("length"))).alias("_start"),
        F.avg(F.when(has_len & (F.col("len_rn") > F.col("len_total") - k), F.col("length"))).alias("_end"),
        F.count(F.when(rn <= mid, d)).alias("_c1"),
        F.count_if((rn <= mid) & new_day).alias("_d1"),
        F.count(F.when(rn > mid, d)).alias("_c2"),
        F.count_if((rn > mid) & d.isNotNull() & ((rn == mid + 1) | new_day)).alias("_d2"),
        F.min(F.when(is_churn(), F.col("datetime"))).alias("churn_ts"),
        F.max(is_churn().cast("int")).alias("_churned"),
    )
    r1 = F.try_divide(F.col("_c1").cast("double"), F.col("_d1"))
    r2 = F.try_divide(F.col("_c2").cast("double"), F.col("_d2"))
    thirds_ok = (F.col("_nl") >= 3) & (F.col("_start") != 0)
    halves_ok = (F.col("_n") >= 4) & (r1 != 0)
    x = base.join(user_distincts(users), "userId").withColumn("_end_ts", dataset_end)
    # most frequent weekday, lowest on ties: the greatest of count * 8 + (7 - day)
    wd_key = F.greatest(*[F.col(f"_wd{d}") * F.lit(8) + F.lit(7 - d) for d in range(7)])
    most_common_day = F.when(wd_key >= F.lit(8), F.lit(7) - F.pmod(wd_key, F.lit(8)))
    cols: dict[str, Column] = {
        "gender_code": key_tag("_first_key") - F.lit(1),
        "account_age_days": floor_days("_last", "_reg"),
        "total_events": F.col("total_events"),
        "total_sessions": F.col("total_sessions"),
        "unique_pages": F.col("unique_pages"),
        "unique_days_active": F.col("unique_days_active"),
        "events_per_session": F.try_divide(F.col("total_events").cast("double"), F.nullif(F.col("total_sessions"), F.lit(0))),
        "total_hearing_time": F.col("total_hearing_time"),
        "mean_hearing_time": F.col("mean_hearing_time"),
        "hearing_time_variance": F.col("hearing_time_variance"),
        "hearing_time_change_rate": F.when(thirds_ok, (F.col("_end") - F.col("_start")) / F.col("_start")),
        "unique_user_agents": F.col("unique_user_agents"),
        "unique_browsers": F.col("unique_browsers"),
        "unique_os": F.col("unique_os"),
        "avg_hour_active": F.col("avg_hour_active"),
        "most_common_day": most_common_day,
        "avg_day_of_month": F.col("avg_day_of_month"),
        "days_since_last_activity": floor_days("_end_ts", "_last"),
        "activity_change_rate": F.when(halves_ok, (r2 - r1) / r1),
        "paid_event_share": F.col("paid_event_share"),
        "time_to_churn_days": floor_days("churn_ts", "_first"),
        "is_churned_user": F.coalesce(F.col("_churned"), F.lit(0)),
    }
    return x.select("userId", *[c.cast("double").alias(n) for n, c in cols.items()])


def _pair_corr(a: str, b: str) -> Column:
    """Pearson over rows where both are non-null; null (not an error) when
    a variance is zero or fewer than two pairs exist."""
    x, y = F.col(a), F.col(b)
    xs = F.when(y.isNotNull(), x)
    ys = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))


def pair_moments(table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete centred moments for every ordered column pair, in
    one pass over the table: ``i, j, n, mi, mj, cii, cjj, cij`` where, over
    the rows with both columns non-null, ``n`` counts rows, ``mi``/``mj``
    are the means and ``cii``/``cjj``/``cij`` the sums of squared / crossed
    deviations from them.

    Each partition streams its Arrow batches into k x k matrices with numpy
    (deviations over the rows that have both columns, so rows whose partner
    is null can't disturb a pair) and emits one row per pair.
    Batches and partitions are merged with the parallel-variance formula
    ``C = sum(c_p) + sum(n_p (m_p - M)(m'_p - M'))`` over a window on the
    pair (k*k*partitions rows); ``M`` is taken exactly when all partition
    means agree, so a constant column's variance stays exactly zero."""
    import numpy as np
    import pandas as pd

    k = len(columns)

    def partials(batches):
        # per batch: the means of each pair over the rows that have both, then
        # sums of deviations from them; batches merge by the parallel-variance formula
        acc = None
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=float)
            m = ~np.isnan(x)
            mf, xz = m.astype(float), np.where(m, x, 0.0)
            n = mf.T @ mf
            mean, cii, cij = (np.zeros((k, k)) for _ in range(3))
            for i in range(k):  # rows that have column i
                rows, y = xz[m[:, i]], mf[m[:, i]]
                count = np.maximum(n[i], 1)
                xi = rows[:, [i]]
                # shifted by the pair's own first row: a constant column deviates by exactly 0
                first = y.argmax(0) if len(y) else np.zeros(k, int)
                di, dj = ((xi - xi[first, 0]) * y, (rows - rows[first, np.arange(k)]) * y) if len(y) else (y, y)
                si, sj = di.sum(0), dj.sum(0)
                mean[i] = (xi[first, 0] if len(y) else 0.0) + si / count
                cii[i], cij[i] = (di * di).sum(0) - si * si / count, (di * dj).sum(0) - si * sj / count
            part = (n, mean, cii, cij)
            if acc is None:
                acc = part
                continue
            n0, m0, c0, x0 = acc
            both = n0 + n
            share = np.divide(n, both, out=np.zeros_like(n), where=both > 0)
            gap = np.where((n0 > 0) & (n > 0), mean - m0, 0.0)
            acc = (
                both,
                np.where(n0 > 0, m0 + gap * share, mean),
                c0 + cii + gap * gap * n0 * share,
                x0 + cij + gap * gap.T * n0 * share,
            )
        if acc is None:
            return
        n, mean_i, cii, cij = acc
        ii, jj = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        keep = (n > 0).ravel()
        yield pd.DataFrame({
            "i": ii.ravel()[keep].astype("int32"), "j": jj.ravel()[keep].astype("int32"), "n": n.ravel()[keep],
            "mi": mean_i.ravel()[keep], "mj": mean_i.T.ravel()[keep],
            "cii": cii.ravel()[keep], "cjj": cii.T.ravel()[keep], "cij": cij.ravel()[keep],
        })

    parts = table.select(*[F.col(c).cast("double") for c in columns]).mapInPandas(
        partials, "i int, j int, n double, mi double, mj double, cii double, cjj double, cij double"
    )
    pair = Window.partitionBy("i", "j")

    def grand_mean(c: str) -> Column:
        lo, hi = F.min(c).over(pair), F.max(c).over(pair)
        return F.when(lo == hi, lo).otherwise(F.sum(F.col("n") * F.col(c)).over(pair) / F.sum("n").over(pair))

    x = parts.withColumns({"_Mi": grand_mean("mi"), "_Mj": grand_mean("mj")})
    di, dj = F.col("mi") - F.col("_Mi"), F.col("mj") - F.col("_Mj")
    return x.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.first("_Mi").alias("mi"),
        F.first("_Mj").alias("mj"),
        F.sum(F.col("cii") + F.col("n") * di * di).alias("cii"),
        F.sum(F.col("cjj") + F.col("n") * dj * dj).alias("cjj"),
        F.sum(F.col("cij") + F.col("n") * di * dj).alias("cij"),
    )


def correlation_matrix(table: DataFrame, columns: list[str] = USER_COLUMNS) -> DataFrame:
    """``feature_a, feature_b, corr`` for every ordered pair (Pearson over
    rows where both are non-null; null for zero variance or n < 2), from
    the pairwise centred moments of ``pair_moments`` - one pass over the
    table, k*k small rows after it."""
    mom = pair_moments(table, columns)
    n, cii, cjj, cij = (F.col(c) for c in ("n", "cii", "cjj", "cij"))
    r = F.try_divide(cij, F.sqrt(cii * cjj))
    corr = F.when((n >= 2) & (cii > 0) & (cjj > 0) & ~F.isnan(r), r)
    names = F.array(*[F.lit(c) for c in columns])
    return mom.select(
        F.element_at(names, F.col("i") + 1).alias("feature_a"),
        F.element_at(names, F.col("j") + 1).alias("feature_b"),
        corr.alias("corr"),
    )


def correlation_with(table: DataFrame, target: str = TARGET, columns: list[str] = USER_COLUMNS) -> DataFrame:
    """``feature, corr`` of every column with ``target`` (target included)."""
    agg = table.agg(*[_pair_corr(c, target).alias(f"_c{i}") for i, c in enumerate(columns)])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("corr")) for i, c in enumerate(columns)]
    return agg.select(F.inline(F.array(*entries)))


def top_abs_correlations(corr: DataFrame, target: str = TARGET, k: int = 12) -> DataFrame:
    """The ``k`` strongest correlations by absolute value, target excluded
    (a top-k report over at most a few dozen rows)."""
    return (
        corr.filter(F.col("feature") != target)
        .orderBy(F.abs("corr").desc_nulls_last(), F.col("feature").asc())
        .limit(k)
    )


def missing_users(base: DataFrame, series: DataFrame, key: str = "userId") -> DataFrame:
    """Users of ``base`` absent from ``series`` (anti-join)."""
    return base.select(key).join(series.select(key), key, "left_anti")


def assert_user_table(table: DataFrame, base: DataFrame) -> DataFrame:
    """Row count vs. base users, and null keys (expect equal and 0)."""
    n_base = base.select(F.count_distinct("userId")).scalar()
    return table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("userId").isNull()).alias("null_keys"),
    ).select("rows", n_base.alias("base_users"), "null_keys")
