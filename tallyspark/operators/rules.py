"""Insights, recommended actions and report lines: rules over computed facts.

Every rule is a filter over a small frame of results; a rule that cannot be
evaluated adds no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import numbers, periods
from tallyspark.functions.numbers import display, number, ratio
from tallyspark.model import AnalysisError, Dataset
from tallyspark.operators import change, forecast, goals, overview, series, slices

# Thresholds of the insight and action rules.
TREND_PCT, MOMENTUM_PCT, CONCENTRATION_PCT = 5, 8, 40
MARGIN_GOOD, MARGIN_POOR = 15, 8
DECLINE, SHARP_DECLINE, GROWTH, MATERIAL = -0.15, -0.3, 0.20, 0.05
FAIR_SHARE_MULTIPLE, MISSING_SHARE = 1.5, 0.05
PRICE_OF_CHANGE, PRICE_OF_VALUE = 0.25, 0.02
SEVERITIES = ("critical", "warning", "good", "info")
URGENCY = ("high", "medium", "low")


def _title(name: str) -> str:
    return numbers.words(name).title()


def _place(value: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in order]), value)


def _insight(df: DataFrame, severity: Column | str, category: str, subject: Column | str, metric: Column,
             title: Column, detail: Column) -> DataFrame:
    def lit(v):
        return F.lit(v) if isinstance(v, str) else v
    return df.select(lit(severity).alias("severity"), F.lit(category).alias("category"),
                     lit(subject).cast("string").alias("subject"), metric.cast("double").alias("metric"),
                     title.alias("title"), detail.alias("detail"))


def insights(ds: Dataset, measure: str | None = None, monthly: DataFrame | None = None,
             shares: DataFrame | None = None) -> DataFrame:
    """What stands out in a slice, most severe first by ``position``.

    ``monthly`` and ``shares`` may come from a caller that has them; otherwise
    these small aggregates are kept, since several rules read them."""
    pm = ds.need_measure(measure)
    kinds, label = ds.measures, _title(pm)
    kind = kinds[pm]
    rules: list[DataFrame] = []
    say = F.concat
    if ds.date_column:
        monthly = overview.monthly_series(ds).persist() if monthly is None else monthly
        own = monthly.where(F.col("measure") == pm)
        order = Window.partitionBy("measure").orderBy("period_key")
        ends = own.withColumn("before", F.lag("value").over(order)).withColumn(
            "before_key", F.lag("period_key").over(order)).agg(
            F.count(F.lit(1)).alias("n"), F.min_by("value", "period_key").alias("first"),
            F.max_by("value", "period_key").alias("last"), F.min("period_key").alias("from"),
            F.max("period_key").alias("to"), F.max_by("before", "period_key").alias("before"),
            F.max_by("before_key", "period_key").alias("before_key")).where("n >= 2")
        move = numbers.pct_change(F.col("last"), F.col("first"))
        way = F.when(move >= TREND_PCT, "up").when(move <= -TREND_PCT, "down").otherwise("flat")
        span = say(F.lit(" from "), periods.prose(F.col("from")), F.lit(" ("), display(F.col("first"), kind),
                   F.lit(") to "), periods.prose(F.col("to")), F.lit(" ("), display(F.col("last"), kind), F.lit(")."))
        rules.append(_insight(
            ends.where(move.isNotNull()), F.when(way == "up", "good").when(way == "down", "warning").otherwise("info"),
            "trend", pm, move,
            F.when(way == "flat", F.lit(f"{label} is broadly flat")).otherwise(
                say(F.lit(f"{label} is trending "), way)),
            F.when(way == "flat", F.format_string(f"{label} moved %+.1f%% across the period — no strong trend.", move))
            .otherwise(say(F.when(way == "up", F.lit(f"{label} rose ")).otherwise(F.lit(f"{label} fell ")),
                           F.format_string("%+.1f%%", move), span))))
        mom = numbers.pct_change(F.col("last"), F.col("before"))
        rules.append(_insight(
            ends.where(F.abs(mom) >= MOMENTUM_PCT), F.when(mom > 0, "good").otherwise("warning"), "momentum",
            F.date_format("to", "yyyy-MM"), mom,
            say(F.when(mom > 0, F.lit("Latest month jumped ")).otherwise(F.lit("Latest month dropped ")),
                F.format_string("%.0f%%", F.abs(mom))),
            say(F.lit(f"{label} went from "), display(F.col("before"), kind), F.lit(" in "),
                periods.prose(F.col("before_key")), F.lit(" to "), display(F.col("last"), kind), F.lit(" in "),
                periods.prose(F.col("to")), F.format_string(" (%+.1f%%).", mom))))
        ahead = forecast.forecast(own, 1)
        name = F.element_at(F.create_map(*[F.lit(x) for kv in forecast.LABELS.items() for x in kv]), F.col("method"))
        track = F.when(F.col("mape").isNotNull(), say(
            F.lit(" Using "), name, F.format_string(
                ", which was off by %.0f%% on average when tested against the last %d months.", "mape", "months")
        )).otherwise(F.lit(""))
        rules.append(_insight(
            ahead, "info", "forecast", F.date_format("period_key", "yyyy-MM"), F.col("value"),
            say(F.lit("Projected next month: "), display(F.col("value"), kind)),
            say(F.lit(f"{label} is projected at "), display(F.col("value"), kind), F.lit(" in "),
                periods.prose(F.col("period_key")), F.lit(" (range "), display(F.col("lower"), kind), F.lit("–"),
                display(F.col("upper"), kind), F.lit(")."), track,
                F.lit(" This is a model projection, not a guarantee."))))
        odd = series.anomalies(monthly.join(
            monthly.groupBy("measure").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("measure"), "measure"))
        once = Window.partitionBy("period_key").orderBy(F.col("measure") != pm, "measure")
        odd = odd.withColumn("k", F.row_number().over(once)).where("k = 1")
        sub = F.element_at(F.create_map(*[F.lit(x) for m, s in kinds.items() for x in (m, s or "count")]),
                           F.col("measure"))
        rules.append(_insight(
            odd, F.col("severity"), "anomaly", F.date_format("period_key", "yyyy-MM"), F.col("value"),
            say(F.lit("Unusual "), F.col("direction"), F.lit(" in "), periods.prose(F.col("period_key"))),
            say(F.initcap(F.regexp_replace("measure", "_", " ")), F.lit(" was "), display(F.col("value"), sub),
                F.lit(" in "), periods.prose(F.col("period_key")), F.lit(", vs an expected ~"),
                display(F.col("expected"), sub), F.lit(". Worth investigating."))))
        rev = next((m for m in kinds if "revenue" in m.lower() or "sales" in m.lower()), None)
        prof = next((m for m in kinds if "profit" in m.lower()), None)
        if rev and prof:
            both = monthly.groupBy().agg(F.sum(F.when(F.col("measure") == rev, F.col("value"))).alias("r"),
                                         F.sum(F.when(F.col("measure") == prof, F.col("value"))).alias("p"))
            margin = ratio(F.col("p"), F.col("r")) * 100
            rules.append(_insight(
                both.where(margin.isNotNull()),
                F.when(margin >= MARGIN_GOOD, "good").when(margin < MARGIN_POOR, "warning").otherwise("info"),
                "margin", prof, margin, F.format_string("Overall margin: %.1f%%", margin),
                F.format_string(f"{_title(prof)} is %.1f%% of {_title(rev)}.", margin)))
    if ds.dimensions:
        dim = next(iter(ds.dimensions))
        shares = overview.breakdown_shares(ds, pm).persist() if shares is None else shares
        mine = shares.where(F.col("dimension") == dim)
        members = mine.agg(F.count_if(F.col("rank").isNotNull())).scalar()
        lead = mine.where("rank = 1")
        pct = F.format_string("%.0f%%", F.col("share_pct"))
        rules.append(_insight(
            lead.where((F.col("share_pct") >= CONCENTRATION_PCT) & (members >= 2)), "warning", "concentration",
            F.col("member"), F.col("share_pct"), say(F.lit("High concentration in "), "member"),
            say("member", F.lit(" alone accounts for "), pct, F.lit(f" of {label} across {_title(dim)} — a dependency "
                                                                    "risk."))))
        rules.append(_insight(
            lead, "good", "leader", F.col("member"), F.col("value"), say(F.lit(f"Top {_title(dim)}: "), "member"),
            say("member", F.lit(f" leads {_title(dim)} with "), display(F.col("value"), kind), F.lit(" ("), pct,
                F.lit(" share)."))))
        vital = series.pareto(mine).where("rank = 1 and n_for_80 is not null and total_categories > n_for_80")
        rules.append(_insight(
            vital, "info", "pareto", dim, F.col("n_for_80"),
            F.format_string(f"Pareto: %d of %d {_title(dim)} drive ~80%%", "n_for_80", "total_categories"),
            F.format_string(f"The top %d of %d {_title(dim).lower()} account for about 80%% of {label} — focus effort "
                            "there.", "n_for_80", "total_categories")))
    out = None
    for i, rule in enumerate(rules):
        rule = rule.withColumn("rule", F.lit(i))
        out = rule if out is None else out.unionByName(rule)
    if out is None:
        raise AnalysisError("nothing to look at: no date column and no dimension")
    rank = Window.orderBy(_place(F.col("severity"), SEVERITIES), "rule", "subject")  # a handful of rows
    return out.withColumn("position", F.row_number().over(rank)).drop("rule")


# --------------------------------------------------------------- actions ---

def _action(df: DataFrame, kind: str, subject: Column | str, severity: Column | str, magnitude: Column, title: Column,
            why: Column, step: Column, evidence: Column | None = None) -> DataFrame:
    def lit(v):
        return F.lit(v) if isinstance(v, str) else v
    empty = F.create_map().cast("map<string,string>")
    return df.select(F.concat(F.lit(f"{kind}:"), lit(subject)).alias("id"), F.lit(kind).alias("kind"),
                     lit(severity).alias("severity"), F.abs(magnitude).cast("double").alias("magnitude"),
                     title.alias("title"), why.alias("why"), step.alias("step"), (empty if evidence is None else evidence).alias("evidence"))


def actions(ds: Dataset, measure: str | None = None, targets: Sequence[goals.Target] = (), limit: int = 8) -> DataFrame:
    """What to look into next, most urgent first: why, the ``step`` to take, and
    the slice that proves it."""
    m = ds.need_measure(measure)
    kind, name = ds.measures[m], numbers.words(m)
    rules: list[DataFrame] = []
    say = F.concat
    if ds.date_column and ds.data_end() is not None:
        per = change.comparison(ds)
        words = f"from {per.a.label} to {per.b.label}"
        unusual = change.significance(ds, m).where("level <> 'normal'")
        total = change.period_totals(ds, m)
        delta = total.select("delta").scalar()
        down = delta < 0
        rules.append(_action(
            unusual.where(delta != 0), "unusual_move", m, F.when(F.col("level") == "unusual", "high").otherwise(
                "medium"), delta, say(F.lit("Investigate the "), F.when(down, "drop").otherwise("jump"),
                                      F.lit(f" in {name}")),
            say(F.lit(f"{name.capitalize()} "), F.when(down, "fell ").otherwise("rose "), display(F.abs(delta), kind),
                F.lit(f" {words}: "), F.format_string("%.1f", F.abs("z")), F.lit("× its typical swing of "),
                display(F.col("typical_change"), kind), F.lit(".")),
            F.lit("See which members moved it before deciding anything.")))
        if ds.free_dimensions:
            dim = change.best_split(ds, m)
            steps = change.waterfall(ds, m, dimension=dim, limit=change.MAX_STEPS).where("not blank and not is_other")
            whole = total.select(F.struct("a", "b")).scalar()
            moved = ratio(F.col("delta"), F.abs("a"))
            proof = F.create_map(F.lit(dim), F.col("member"))
            key = say(F.lit(f"{dim}="), F.col("member"))
            line = say(F.lit(f"{numbers.words(dim).capitalize()} "), "member", F.lit(": "), display(F.col("a"), kind),
                       F.lit(" → "), display(F.col("b"), kind), F.format_string(" (%+.0f%%)", moved * 100),
                       F.lit(f" {words}"))
            # a loss is put in proportion to the loss of the whole
            part = F.when(F.col("whole.b") < F.col("whole.a"), F.coalesce(F.format_string(
                ", %.0f%% of the overall change", F.abs("share_of_change") * 100), F.lit(""))).otherwise(F.lit(""))
            seg = steps.withColumn("whole", whole)
            fell = (moved <= DECLINE) & (ratio(F.col("a"), F.col("whole.a")) >= MATERIAL)
            grew = (moved >= GROWTH) & (ratio(F.col("b"), F.col("whole.b")) >= MATERIAL)
            rules.append(_action(seg.where(fell), "declining_segment", key, F.when(
                moved <= SHARP_DECLINE, "high").otherwise("medium"), F.col("delta"),
                say(F.lit("Find out why "), "member", F.lit(" is falling")), say(line, part, F.lit(".")),
                say(F.lit("Open the rows of "), "member", F.lit(" and split them again: price, supply or a lost customer.")), proof))
            rules.append(_action(seg.where(grew), "growing_segment", key, "low", F.col("delta"),
                                 say(F.lit("Build on "), "member", F.lit("'s growth")), say(line, F.lit(".")),
                                 say(F.lit("Learn what "), "member", F.lit(
                                     f" does differently and try it with another {numbers.words(dim)}.")), proof))
        volume = change.guess_volume(ds, m)
        if volume:
            parts = change.price_volume_mix(ds, m, volume)
            effect = change.price_volume_mix_total(parts)
            worst = parts.agg(F.min_by(F.struct("member", "price_effect"), F.struct("price_effect", "member")).alias("w"))
            effect = effect.withColumn("worst", worst.select("w").scalar())
            where = F.when((F.col("worst.price_effect") < 0) & F.col("worst.member").isNotNull(), say(
                F.lit(", most of it in "), "worst.member")).otherwise(F.lit(""))
            cost = (F.col("price_effect") < 0) & (
                (F.abs("price_effect") >= PRICE_OF_CHANGE * F.abs(F.when(F.col("delta") == 0, 1.0).otherwise(
                    F.col("delta")))) | (F.abs("price_effect") >= PRICE_OF_VALUE * F.abs("value_a")))
            rules.append(_action(
                effect.where(cost), "price_erosion", m, "medium", F.col("price_effect"),
                F.lit("Review pricing and discounts"),
                say(F.lit("The average price went from "), display(F.col("avg_price_a"), kind), F.lit(" to "),
                    display(F.col("avg_price_b"), kind), F.lit(f" ({name} per {numbers.words(volume)}); price changes alone cost "),
                    display(F.abs("price_effect"), kind), where, F.lit(".")),
                F.lit("Go through discounts and price lists before asking for more volume.")))
        mine = [t for t in targets if t.measure == m and dict(t.filters) == dict(ds.pinned)]
        if mine:
            t = goals.evaluate_targets(ds, mine).where("current and status in ('at_risk', 'off_track')")
            rules.append(_action(
                t, "target", F.col("target_id"), F.when(F.col("status") == "off_track", "high").otherwise("medium"),
                F.col("gap"), say(F.lit("Close the gap on the "), "period", F.lit(" target")),
                say(F.lit(f"At the current pace {name} reaches "), display(F.col("projection"), kind),
                    F.lit(" against a target of "), display(F.col("goal"), kind),
                    F.format_string(" (%.0f%%).", F.col("projected_ratio") * 100)),
                say(F.lit("Plan for "), display(F.col("needed_per_day"), kind), F.lit(" a day over the "),
                    F.when(F.col("days_remaining") == 1, F.lit("one day")).otherwise(F.format_string(
                        "%d days", "days_remaining")), F.lit(" left."))))
    if ds.free_dimensions:
        tops = slices.contributors(ds, m, "sum", 1)
        found = tops.groupBy("dimension").agg(
            F.max(F.when(F.col("rank") == 1, F.col("member"))).alias("member"),
            F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("value"),
            F.max(F.when(F.col("rank") == 1, F.col("share_pct"))).alias("share_pct"),
            (F.count_if(F.col("rank") == 1) + F.sum("folded")).alias("members"))
        bar = F.greatest(F.lit(float(CONCENTRATION_PCT)), FAIR_SHARE_MULTIPLE * 100 / F.col("members"))
        best = found.where((F.col("members") >= 3) & (F.col("share_pct") >= bar)).orderBy(
            F.desc("share_pct"), "dimension").limit(1)
        rules.append(_action(
            best, "concentration", say("dimension", F.lit("="), "member"), "medium", F.col("value"),
            say(F.lit("Reduce dependence on "), "member"),
            say("member", F.format_string(f" is %.0f%% of all {name} across %d ", "share_pct", "members"),
                F.regexp_replace("dimension", "_", " "), F.lit(" values.")),
            say(F.lit("Secure "), "member", F.lit(" and grow the others: its trouble would be everyone's.")),
            F.create_map("dimension", "member")))
    gaps = ds.frame.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(number(m))).alias("missing"))
    rules.append(_action(
        gaps.where(ratio(F.col("missing"), F.col("n")) >= MISSING_SHARE), "missing_values", m, "medium",
        F.col("missing"), F.lit(f"Fill in missing {name}"),
        F.format_string(f"%,d of %,d rows (%.0f%%) have no {name}, so every total understates it.", "missing", "n",
                        ratio(F.col("missing"), F.col("n")) * 100),
        F.lit("Repair the source, or leave these rows out on purpose.")))
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    urgency = Window.orderBy(_place(F.col("severity"), URGENCY), F.desc("magnitude"), "id")  # a few rows a rule
    return out.withColumn("position", F.row_number().over(urgency)).where(F.col("position") <= max(1, min(limit, 20)))
