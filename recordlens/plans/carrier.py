"""Independent carrier indicator over all carriers: census, crashes, inspections, flags, decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordlens.functions import dates, fixed, numbers, text
from recordlens.operators.aggregates import crash_summary, inspection_rates


def _flag(when: Column, level: str, body: Column) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), body.alias("text")))


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else text.blank(p.cast("string"))
                      for p in parts])


def carrier_indicator(requests: DataFrame, census: DataFrame, crashes: DataFrame,
                      inspections: DataFrame, *, as_of: str) -> DataFrame:
    """Indicator, flags and decision for each requested carrier number.

    A carrier has at most eight flags, one per rule.
    """
    one = census.groupBy(F.col("dot_number").alias("_dot")).agg(
        F.min(F.struct("legal_name", "status_code", "power_units", "total_drivers", "add_date"))
        .alias("c"))
    cr = crash_summary(crashes, as_of=as_of).select(
        "dot_number", F.col("recent_total").alias("crashes_24m"))
    ins = inspection_rates(inspections, as_of=as_of).select(
        "dot_number", F.col("recent_total").alias("inspections_24m"), "vehicle_oos_pct",
        "driver_oos_pct")
    req = requests.select(F.regexp_replace("dot_number", r"\D", "").alias("dot_number")).distinct()
    j = req.join(one, req["dot_number"] == F.col("_dot"), "left").join(
        cr, "dot_number", "left").join(ins, "dot_number", "left")
    c = F.col
    units = numbers.int_or_zero(c("c.power_units"))
    drivers = numbers.int_or_zero(c("c.total_drivers"))
    added = F.try_to_date(F.nullif(dates.compact_to_iso(c("c.add_date")), F.lit("")), "yyyy-MM-dd")
    j = j.select(
        "dot_number", c("_dot").isNotNull().alias("known"), c("c.legal_name").alias("legal_name"),
        c("c.status_code").alias("status_code"),
        (F.upper(text.blank(c("c.status_code"))) == "A").alias("active"),
        units.alias("units"), drivers.alias("drivers"),
        dates.months_since(added, as_of).alias("months"),
        F.coalesce("crashes_24m", F.lit(0)).alias("crashes"),
        F.coalesce("inspections_24m", F.lit(0)).alias("inspections"),
        "vehicle_oos_pct", "driver_oos_pct")
    per_unit = numbers.ratio(c("drivers"), c("units"))
    per_driver = c("units") / F.greatest(c("drivers"), F.lit(1))
    odd_ratio = (c("units") > 0) & (c("drivers") > 0) & ((per_unit > 4) | (per_driver > 4))
    per_100 = numbers.ratio(c("crashes") * 100, c("units"))
    few = c("inspections") < 3
    yes = lambda x: F.coalesce(x, F.lit(False))
    new6, new12 = yes(c("months") < 6), yes((c("months") >= 6) & (c("months") < 12))
    vehicle = ~few & yes(c("vehicle_oos_pct") > fixed.NATIONAL_VEHICLE_OOS + 8)
    driver = ~few & yes(c("driver_oos_pct") > fixed.NATIONAL_DRIVER_OOS + 4)
    crash = (c("crashes") > 0) & yes(per_100 > 40)
    points = [(~c("active"), 60), (new6, 25), (new12, 12), (c("units") == 0, 15), (odd_ratio, 8),
              (few, 6), (vehicle, 12), (driver, 10), (crash, 10)]
    concern = sum((F.when(cond, p).otherwise(0) for cond, p in points), F.lit(8))
    months = numbers.half_up(c("months"))
    flags = F.array_compact(F.array(
        _flag(~c("known"), "verify", F.lit("No census record for this number; confirm it first.")),
        _flag(c("known") & ~c("active"), "stop", _say(
            "Operating status is ", c("status_code"), " and not active. Do not tender a load.")),
        _flag(c("known") & new6, "elevated", _say(
            "First seen in the records about ", months, " months ago. Verify authority, insurance "
            "and operation.")),
        _flag(c("known") & new12, "verify", _say(
            "Fairly new to the records (about ", months, " months).")),
        _flag(c("known") & (c("units") == 0), "elevated", F.lit(
            "No power unit is on file. Ask which truck would carry the load.")),
        _flag(c("known") & odd_ratio, "verify", _say(
            "Unusual ratio of ", c("drivers"), " drivers to ", c("units"), " power units.")),
        _flag(c("known") & few, "verify", _say(
            "Only ", c("inspections"), " roadside inspections in 24 months; too few to judge.")),
        _flag(c("known") & vehicle, "elevated", _say(
            "More vehicles are put out of service than usual for the country, at ",
            c("vehicle_oos_pct"), " per cent.")),
        _flag(c("known") & driver, "elevated", _say(
            "More drivers are put out of service than usual for the country, at ",
            c("driver_oos_pct"), " per cent.")),
        _flag(c("known") & crash, "elevated", _say(
            "Crashes are frequent for the fleet: ", c("crashes"), " in 24 months with ", c("units"),
            " power units.")),
    ))
    indicator = numbers.clamp_100(concern).cast("int")
    decision = (
        F.when(~c("known"), fixed.DECISION_VERIFY)
        .when(~c("active") | (c("indicator") >= 70), fixed.DECISION_STOP)
        .when(c("indicator") >= 40, fixed.DECISION_ELEVATED)
        .when((c("indicator") >= 18) | few, fixed.DECISION_VERIFY)
        .otherwise(fixed.DECISION_LOWER))
    return j.withColumn("indicator", F.when(c("known"), indicator)).withColumn(
        "flags", flags).withColumn("decision", decision)


def carrier_verdict(assessed: DataFrame) -> DataFrame:
    """One paragraph per carrier: the decision, then the deciding flag or two elevated ones."""
    c = F.col
    name = F.when(text.is_blank(c("legal_name")), F.concat(F.lit("USDOT "), c("dot_number"))) \
        .otherwise(c("legal_name"))
    lead = (
        F.when(c("decision") == fixed.DECISION_STOP, " shows a stop-and-resolve condition")
        .when(c("decision") == fixed.DECISION_ELEVATED, " shows elevated concern")
        .when(c("decision") == fixed.DECISION_VERIFY, " needs manual verification")
        .otherwise(" shows lower observed concern"))
    first_sentence = lambda x: F.lower(F.substring_index(x, ".", 1))
    stop = F.filter("flags", lambda f: f["level"] == "stop")
    high = F.filter("flags", lambda f: f["level"] == "elevated")
    detail = (
        F.when(F.size(stop) > 0, F.concat(F.lit(" Deciding issue: "),
                                          first_sentence(F.get(stop, F.lit(0))["text"]), F.lit(".")))
        .when(F.size(high) > 0, F.concat(
            F.lit(" Key points: "),
            F.array_join(F.transform(F.slice(high, 1, 2), lambda f: first_sentence(f["text"])), "; "),
            F.lit(".")))
        .otherwise(" No warning sign is on record, which does not prove who is on the phone."))
    known = F.concat(name, lead, F.lit(" in the public record."), detail,
                     F.lit(" This supports a decision and guarantees nothing."))
    unknown = F.concat(F.lit("No census record was found for USDOT "), c("dot_number"),
                       F.lit("; treat every claim as unconfirmed."))
    return assessed.select("dot_number", "decision", "indicator",
                           F.when(c("known"), known).otherwise(unknown).alias("verdict"))
