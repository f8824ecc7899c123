"""Declarative data-quality contracts, receipts, policies, routing and drafting.

A contract is a short list of check definitions (plain dicts): ``type``, ``critical`` and the
type's parameters. Two forms are run:

* ``run_contract`` checks a table, or many tables stacked under key columns, in one scan;
* ``check_responses`` checks landed response bodies row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordlens.functions import dates, fixed, jsonpath, numbers, text
from recordlens.operators import aggregates, ranking, sequences

RESULT_COLUMNS = ["check_idx", "type", "dimension", "critical", "ok", "failed", "checked",
                  "rows_found", "rows_expected", "detail"]


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# ------------------------------------------------------------------ access to fields
class Rows:
    """How a contract reads one row: columns of a table, or paths of a JSON row column."""

    def __init__(self, df: DataFrame, json_col: str | None = None, row_flag: str | None = None):
        self.columns = set(df.columns)
        self.doc = None if json_col is None else F.col(json_col)
        self.is_row = F.lit(True) if row_flag is None else F.col(row_flag)

    def present(self, field: str) -> Column:
        if self.doc is None:
            return F.lit(field in self.columns)
        return jsonpath.present(self.doc, field)

    def value(self, field: str) -> Column:
        if self.doc is None:
            return F.col(field).cast("string") if field in self.columns else \
                F.lit(None).cast("string")
        return jsonpath.scalar(self.doc, field)


# ------------------------------------------------------------------ row conditions
def out_of_range(v: Column, check: dict) -> Column:
    """Not a number or outside the bounds; declared sentinel values are let through."""
    n = numbers.number(v)
    bad = n.isNull()
    if check.get("min") is not None:
        bad = bad | (n < check["min"])
    if check.get("max") is not None:
        bad = bad | (n > check["max"])
    allowed = [str(a) for a in check.get("allow_values", [])]
    hit = F.coalesce(v.isin(allowed), F.lit(False)) if allowed else F.lit(False)
    return ~hit & F.coalesce(bad, F.lit(True))


def known_answer_ok(v: Column, check: dict) -> Column:
    if check.get("equals") is not None:
        ok = v == str(check["equals"])
    elif check.get("contains") is not None:
        ok = F.contains(v, F.lit(check["contains"]))
    elif check.get("min_number") is not None or check.get("max_number") is not None:
        n = numbers.number(v)
        ok = n.isNotNull()
        if check.get("min_number") is not None:
            ok = ok & (n >= check["min_number"])
        if check.get("max_number") is not None:
            ok = ok & (n <= check["max_number"])
    else:
        ok = v.isNotNull()
    return F.coalesce(ok, F.lit(False))


def timestamp_of(v: Column, unit: str | None) -> Column:
    if unit == "epoch_ms":
        return F.timestamp_millis(numbers.number(v).cast("bigint"))
    if unit == "epoch_s":
        return F.timestamp_millis((numbers.number(v) * 1000).cast("bigint"))
    return F.try_to_timestamp(v)


def too_old(ts: Column, max_age_hours: float, as_of: str) -> Column:
    """True for a missing or old timestamp; one in the future is fresh."""
    age_ms = dates.epoch_ms(F.lit(as_of).cast("timestamp")) - dates.epoch_ms(ts)
    return F.coalesce(age_ms / 3_600_000 > max_age_hours, F.lit(True))


# ------------------------------------------------------------------ table contracts
def _row_counters(checks: Sequence[dict], rows: Rows, as_of: str) -> dict[str, tuple]:
    """Mergeable aggregates the checks need: name -> (first-level expression, merge function)."""
    real = rows.is_row
    out: dict[str, tuple] = {"rows": (F.count_if(real), F.sum)}

    def count(name: str, cond: Column) -> None:
        out[name] = (F.count_if(real & F.coalesce(cond, F.lit(True))), F.sum)

    for i, ch in enumerate(checks):
        kind = ch["type"]
        if kind == "status":
            out[f"c{i}"] = (F.count_if(~F.col(ch.get("field", "status")).eqNullSafe(
                F.lit(ch.get("equals", 200)))), F.sum)
        elif kind == "json":
            doc = rows.doc if rows.doc is not None else jsonpath.parse(F.col(ch["field"]))
            out[f"c{i}"] = (F.count_if(doc.isNull()), F.sum)
        elif kind == "max_latency":
            ok = F.col(ch["field"]) <= ch.get("ms", 15000)
            out[f"c{i}"] = (F.count_if(~F.coalesce(ok, F.lit(False))), F.sum)
        elif kind == "fields_present":
            missing = [~rows.present(f) for f in ch["fields"]]
            count(f"c{i}", reduce(lambda a, b: a | b, missing, F.lit(False)))
        elif kind == "field_pattern":
            count(f"c{i}", ~rows.value(ch["field"]).rlike(ch["pattern"]))
        elif kind == "value_range":
            count(f"c{i}", out_of_range(rows.value(ch["field"]), ch))
        elif kind == "known_answer":
            # the answer row: the first by an ordering field, or the row that meets a condition
            if "where" in ch:
                at = F.when(real & F.expr(ch["where"]), F.struct(rows.value(ch["field"]).alias("v")))
                out[f"c{i}"] = (F.min(at), F.min)
            else:
                key = numbers.number(rows.value(ch["first_by"]))
                at = F.when(real, F.struct(key.alias("k"), rows.value(ch["field"]).alias("v")))
                out[f"c{i}"] = (F.min(at), F.min)
        elif kind == "freshness":
            ts = timestamp_of(rows.value(ch["field"]), ch.get("unit"))
            if "first_by" in ch:
                key = numbers.number(rows.value(ch["first_by"]))
                out[f"c{i}"] = (F.min(F.when(real, F.struct(key.alias("k"), ts.alias("v")))), F.min)
            else:
                out[f"c{i}"] = (F.max(F.when(real, F.struct(ts.alias("v")))), F.max)
    return out


def _outcomes(checks: Sequence[dict], as_of: str) -> Column:
    """Array of result structs from the merged aggregates, one per check."""
    rows = F.col("rows")
    results = []
    for i, ch in enumerate(checks):
        kind, c = ch["type"], F.col(f"c{i}")
        none = F.lit(None).cast("bigint")
        found, expected, checked = none, none, rows
        if kind in ("status", "json", "max_latency"):
            failed = c
            ok = failed == 0
        elif kind == "min_rows":
            need = lit(ch.get("min", 1)).cast("bigint")
            failed = F.greatest(F.lit(0), need - rows)
            ok, found, expected = rows >= need, rows, need
        elif kind == "unique_field":
            failed = c
            ok = (rows > 0) & (failed == 0)
        elif kind in ("fields_present", "field_pattern", "value_range"):
            failed = c
            ok = (rows > 0) & (failed == 0)
        elif kind == "known_answer":
            ok = known_answer_ok(c["v"], ch)
            failed, checked = F.when(ok, 0).otherwise(1), F.lit(1)
        elif kind == "freshness":
            ok = ~too_old(c["v"], ch["max_age_hours"], as_of)
            failed, checked = F.when(ok, 0).otherwise(1), F.lit(1)
        else:
            ok, failed, checked = F.lit(False), F.lit(0), F.lit(0)
        what = ch.get("field") or ",".join(ch.get("fields", [])) or kind
        detail = F.when(ok, F.concat(F.lit(f"{what}: ok")))
        bad = f"unknown check type: {kind}" if kind not in fixed.CHECK_DIMENSION else None
        detail = F.coalesce(
            detail, F.lit(bad) if bad else
            F.when(rows == 0, F.lit(f"{what}: no rows to inspect")).otherwise(F.concat(
                F.lit(f"{what}: "), failed.cast("string"), F.lit(" of "),
                checked.cast("string"), F.lit(" failed"))))
        results.append(F.struct(
            F.lit(i).alias("check_idx"), F.lit(kind).alias("type"),
            F.lit(fixed.CHECK_DIMENSION.get(kind, "task")).alias("dimension"),
            F.lit(ch.get("critical", True) is not False).alias("critical"),
            F.coalesce(ok, F.lit(False)).alias("ok"), failed.cast("bigint").alias("failed"),
            checked.cast("bigint").alias("checked"), found.alias("rows_found"),
            expected.alias("rows_expected"), detail.alias("detail")))
    return F.array(*results)


def run_contract(df: DataFrame, checks: Sequence[dict], *, as_of: str, keys: Sequence[str] = (),
                 json_col: str | None = None, row_flag: str | None = None) -> DataFrame:
    """All checks of a contract as rows, from one scan.

    Counters are mergeable aggregates. A uniqueness check adds its field as a first grouping level,
    so the same scan counts duplicated values and one very frequent value is merged on the map side.
    A contract with several uniqueness checks is split into one scan per further field.
    """
    unique = [i for i, ch in enumerate(checks) if ch["type"] == "unique_field"]
    if len(unique) > 1:
        first = [c for i, c in enumerate(checks) if i not in unique[1:]]
        index = [i for i in range(len(checks)) if i not in unique[1:]]
        parts = [(first, index)] + [([checks[i]], [i]) for i in unique[1:]]
        frames = []
        for part, idx in parts:
            r = run_contract(df, part, as_of=as_of, keys=keys, json_col=json_col, row_flag=row_flag)
            frames.append(r.withColumn("check_idx", F.element_at(
                F.array(*[F.lit(x) for x in idx]), F.col("check_idx") + 1)))
        return reduce(DataFrame.unionByName, frames)
    rows = Rows(df, json_col, row_flag)
    counters = _row_counters(checks, rows, as_of)
    if unique:
        i = unique[0]
        # an absent value counts as the text "undefined", so two of them are duplicates
        value = F.coalesce(rows.value(checks[i]["field"]), F.lit("undefined"))
        level1 = df.groupBy(*keys, value.alias("_u")).agg(
            *[e.alias(n) for n, (e, _) in counters.items()])
        merged = [m(n).alias(n) for n, (_, m) in counters.items()]
        agg = level1.groupBy(*keys).agg(*merged, F.count_if(F.col("rows") > 1).alias(f"c{i}"))
    else:
        agg = df.groupBy(*keys).agg(*[e.alias(n) for n, (e, _) in counters.items()])
    agg = agg.fillna(0, subset=["rows"])
    out = agg.select(*keys, F.explode(_outcomes(checks, as_of)).alias("r"))
    return out.select(*keys, "r.*")


# ------------------------------------------------------------------ response contracts
def _response_check(i: int, ch: dict, as_of: str) -> Column:
    kind = ch["type"]
    body = F.col("_body")
    items = jsonpath.rows_at(body, ch.get("path"))
    n = F.size(items)
    none = F.lit(None).cast("bigint")
    found, expected = none, none
    if kind == "status":
        ok = F.col("status").eqNullSafe(F.lit(ch.get("equals", 200)))
    elif kind == "json":
        ok = body.isNotNull()
    elif kind == "max_latency":
        ok = F.col("latency_ms") <= ch.get("ms", 15000)
    elif kind == "min_rows":
        need = ch.get("min", 1)
        ok, found, expected = n >= need, n.cast("bigint"), F.lit(need).cast("bigint")
    elif kind == "fields_present":
        gap = lambda r: reduce(
            lambda a, b: a | b, [~jsonpath.present(r, f) for f in ch.get("fields", [])], F.lit(False))
        ok = (n > 0) & ~F.exists(items, gap)
    elif kind == "field_pattern":
        ok = (n > 0) & F.forall(items, lambda r: F.coalesce(
            jsonpath.scalar(r, ch["field"]).rlike(ch["pattern"]), F.lit(False)))
    elif kind == "value_range":
        ok = (n > 0) & ~F.exists(items, lambda r: out_of_range(jsonpath.scalar(r, ch["field"]), ch))
    elif kind == "unique_field":
        vals = F.transform(items, lambda r: F.coalesce(
            jsonpath.scalar(r, ch["field"]), F.lit("undefined")))
        ok = (n > 0) & (F.size(F.array_distinct(vals)) == n)
    elif kind == "known_answer":
        ok = known_answer_ok(jsonpath.scalar(body, ch.get("path")), ch)
    elif kind == "freshness":
        ok = ~too_old(timestamp_of(jsonpath.scalar(body, ch.get("path")), ch.get("unit")),
                      ch["max_age_hours"], as_of)
    else:
        ok = F.lit(False)
    ok = F.coalesce(ok, F.lit(False))
    broken = F.col("error").isNotNull()
    if kind != "status":
        ok = ok & ~broken
    detail = F.when(ok, "ok").when(broken, F.concat(F.lit("no response: "), F.col("error"))).otherwise(
        f"unknown check type: {kind}" if kind not in fixed.CHECK_DIMENSION
        else f"{ch.get('field') or ch.get('path') or kind} failed")
    return F.struct(
        F.lit(i).alias("check_idx"), F.lit(kind).alias("type"),
        F.lit(fixed.CHECK_DIMENSION.get(kind, "task")).alias("dimension"),
        F.lit(ch.get("critical", True) is not False).alias("critical"), ok.alias("ok"),
        found.alias("rows_found"), expected.alias("rows_expected"), detail.alias("detail"))


def check_responses(responses: DataFrame, contracts: dict[str, Sequence[dict]], *,
                    as_of: str) -> DataFrame:
    """Check rows for landed responses; each row runs its own capability's contract.

    Responses: capability_id, probe_id, status, body_text, latency_ms, error. Every row is checked
    in place (a body is one document), so nothing is shuffled.
    """
    r = responses.withColumn("_body", jsonpath.parse(F.col("body_text")))
    per = None
    for cap, checks in contracts.items():
        arr = F.array(*[_response_check(i, ch, as_of) for i, ch in enumerate(checks)])
        hit = F.col("capability_id") == cap
        per = F.when(hit, arr) if per is None else per.when(hit, arr)
    return r.select("capability_id", "probe_id", F.explode(per).alias("c")).select(
        "capability_id", "probe_id", "c.*")


# ------------------------------------------------------------------ receipts and source state
def receipt_status(probes: DataFrame, *, ttl_hours: float | None = None) -> DataFrame:
    """Receipts: verified, unreachable (no response) or failed_checks, with their expiry."""
    ttl = F.lit(ttl_hours) if ttl_hours is not None else (
        F.coalesce(F.col("ttl_hours"), F.lit(fixed.DEFAULT_TTL_HOURS))
        if "ttl_hours" in probes.columns else F.lit(fixed.DEFAULT_TTL_HOURS))
    at = F.col("verified_at").cast("timestamp")
    return probes.withColumns({
        "status": F.when(F.col("task_success"), "verified")
        .when(F.col("error").isNotNull(), "unreachable").otherwise("failed_checks"),
        "expires_at": F.timestamp_micros(
            F.unix_micros(at) + (ttl * 3_600_000_000).cast("bigint")),
    })


def receipt_fresh(as_of: str) -> Column:
    return F.coalesce(F.col("expires_at") > F.lit(as_of).cast("timestamp"), F.lit(False))


def receipts_of(history: DataFrame) -> DataFrame:
    """Receipts behind a probe history (source, ts, event_id, task_success, ...)."""
    error = F.col("error") if "error" in history.columns else F.lit(None).cast("string")
    probes = history.withColumns({"verified_at": F.col("ts").cast("timestamp"), "error": error})
    return receipt_status(probes)


def source_state(history: DataFrame, order: list[str], *, as_of: str) -> DataFrame:
    """One row per source: latest receipt, freshness, rates, streak, schema changes, confidence."""
    latest = sequences.latest_per_key(receipts_of(history), ["source"], order).withColumn(
        "fresh", receipt_fresh(as_of))
    s = latest.join(aggregates.history_stats(history, as_of=as_of), "source") \
        .join(sequences.verified_streak(history, order), "source") \
        .join(sequences.schema_changes(history, order, as_of=as_of), "source")
    return s.withColumn("confidence", confidence(
        F.col("checks_passed"), F.col("checks_total"), F.col("success_rate_30d")))


def confidence(passed: Column, total: Column, rate30: Column) -> Column:
    """60 % latest check ratio, 40 % 30-day rate (the ratio again while there is no history)."""
    share = F.coalesce(numbers.ratio(passed, total), F.lit(0.0))
    return numbers.half_up_to(share * 0.6 + F.coalesce(rate30, share) * 0.4, 3)


def policy_reasons(rules: dict, *, as_of: str) -> Column:
    """Names of the policy rules a source state violates. A rule of another name is an error."""
    unknown = sorted(set(rules) - set(fixed.POLICY_RULES))
    if unknown:
        raise ValueError(f"unknown policy rules: {', '.join(unknown)}")
    c = F.col
    verified_at = c("verified_at").cast("timestamp")
    age_min = (dates.epoch_ms(F.lit(as_of).cast("timestamp")) - dates.epoch_ms(verified_at)) / 60000
    out = [
        F.when(c("status").isNull(), "never verified"),
        F.when(c("status") != "verified", F.concat(F.lit("status "), c("status"))),
        F.when(c("status").isNotNull() & ~c("fresh"), "receipt expired"),
    ]
    limits = {k: v for k, v in rules.items() if v is not None}
    if "maximum_receipt_age_minutes" in limits:
        out.append(F.when(age_min > limits["maximum_receipt_age_minutes"], "receipt too old"))
    if limits.get("allow_experimental_sources") is False:
        out.append(F.when(c("experimental"), "experimental"))
    if "minimum_consecutive_passes" in limits:
        out.append(F.when(F.coalesce(c("streak"), F.lit(0)) < limits["minimum_consecutive_passes"],
                          "streak too short"))
    if "minimum_success_rate_30d" in limits:
        out.append(F.when(c("success_rate_30d") < limits["minimum_success_rate_30d"],
                          "success rate too low"))
    if "minimum_confidence" in limits:
        out.append(F.when(F.coalesce(c("confidence"), F.lit(0.0)) < limits["minimum_confidence"],
                          "confidence too low"))
    return F.array_compact(F.array(*out))


def policy_gate(state: DataFrame, policies: dict[str, dict] | None = None, *, as_of: str) -> DataFrame:
    """Every source against every policy: allowed, and why not."""
    rows = [F.struct(F.lit(n).alias("policy"), policy_reasons(p, as_of=as_of).alias("reasons"))
            for n, p in (policies or fixed.POLICIES).items()]
    s = state.withColumn("_p", F.explode(F.array(*rows)))
    return s.select(*state.columns, "_p.policy", "_p.reasons").withColumn(
        "allowed", F.size("reasons") == 0)


def is_experimental(scouted: Column, approved: Column) -> Column:
    return F.coalesce(scouted, F.lit(False)) & ~F.coalesce(approved, F.lit(False))


# ------------------------------------------------------------------ search, resolve, route
def resolve_best(candidates: DataFrame, policy: str | dict = "standard", *, as_of: str) -> DataFrame:
    """Decision over all eligible candidates: the approved one of highest confidence, up to three
    fallbacks, and the rejected with their reasons. The policy comes before any cut.

    Columns: position (1 = recommended, 2-4 = fallback, NULL = rejected or beyond), decision.
    """
    return _decide(candidates.filter("eligible"), policy, as_of)


def _decide(candidates: DataFrame, policy: str | dict, as_of: str) -> DataFrame:
    if isinstance(policy, str) and policy not in fixed.POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    rules = fixed.POLICIES[policy] if isinstance(policy, str) else policy
    gated = candidates.withColumn("reasons", policy_reasons(rules, as_of=as_of)).withColumn(
        "allowed", F.size("reasons") == 0)
    order = [F.desc("confidence"), *ranking.rank_order()]
    # four rows at most, so a window without partitions is fine here
    best = gated.filter("allowed").orderBy(*order).limit(4).withColumn(
        "position", F.row_number().over(Window.orderBy(*order))).select("capability_id", "position")
    placed = gated.join(best, "capability_id", "left")
    return placed.withColumn(
        "decision", F.when(F.col("position") == 1, "approved")
        .when(F.col("position").isNotNull(), "fallback")
        .when(F.col("allowed"), "not needed").otherwise("rejected"))


def resolve_capability(candidates: DataFrame, catalog: DataFrame, capability_id,
                       policy: str | dict = "standard", *, as_of: str) -> DataFrame:
    """The same decision over one capability and all of its declared fallbacks."""
    own = catalog.filter(F.col("capability_id") == capability_id)
    wanted = own.select(F.explode(F.array_union(F.array("capability_id"), F.coalesce(
        "fallback_ids", F.array_remove(F.array("capability_id"), F.col("capability_id"))))).alias("capability_id"))
    return _decide(candidates.join(wanted, "capability_id", "left_semi"), policy, as_of)


def route_best(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """First eligible, verified and fresh candidate by rank, with up to three fallbacks: declared ones,
    then the others by rank."""
    order = ranking.rank_order()
    eligible = candidates.filter("eligible")
    best = eligible.filter((F.col("status") == "verified") & F.col("fresh")).orderBy(*order).limit(1)
    declared = best.select("capability_id").join(catalog, "capability_id").select(
        F.posexplode("fallback_ids").alias("place", "id")).groupBy("id").agg(F.min("place").alias("place"))
    taken = declared.select("id").unionByName(best.select(F.col("capability_id").alias("id")))
    others = eligible.join(taken, F.col("capability_id") == F.col("id"), "left_anti").orderBy(*order).limit(3)
    ranked = others.select(F.col("capability_id").alias("id"),
                           F.row_number().over(Window.orderBy(*order)).alias("place"))  # three rows
    listed = declared.withColumn("turn", F.lit(0)).unionByName(ranked.withColumn("turn", F.lit(1)))
    every = listed.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "place", "id"))), lambda x: x["id"]).alias("ids"))
    return best.select(
        "capability_id", "receipt_id", "status", "success_rate_30d",
        F.slice(F.array_remove(every.scalar(), F.col("capability_id")), 1, 3).alias("fallbacks"))


def explain_failure(state: DataFrame) -> DataFrame:
    text_of = (
        F.when(F.col("status").isNull(), "never verified")
        .when(F.col("status") == "verified", "latest probe succeeded")
        .when(F.col("status") == "unreachable", F.concat(
            F.lit("could not be reached: "), F.coalesce("error", F.lit("unknown transport error"))))
        .otherwise("responded but failed checks"))
    return state.withColumn("explanation", text_of)


def capability_list(catalog: DataFrame, latest: DataFrame) -> DataFrame:
    """Catalog rows with the latest receipt, if any."""
    keep = latest.select("capability_id", "receipt_id", "status", "verified_at", "fresh")
    return catalog.join(keep, "capability_id", "left")


def promotion_gate(state: DataFrame, *, streak: int = 3) -> DataFrame:
    return state.withColumn("ready", F.col("streak") >= streak)


# ------------------------------------------------------------------ drafting
SCALARS = ("string", "int", "bigint", "smallint", "tinyint", "double", "float", "boolean")


def draft_contract(df: DataFrame) -> DataFrame:
    """Check rows drafted from a table: half its rows, and its first four always-filled scalars.

    One aggregate pass; the number of columns bounds the listing.
    """
    names = [n for n, t in df.dtypes if t in SCALARS or t.startswith("decimal")]
    prof = df.agg(F.count("*").alias("n"),
                  *[F.count_if(F.col(n).isNull()).alias(f"null_{n}") for n in names])
    filled = F.array_compact(F.array(*[
        F.when((F.col("n") > 0) & (F.col(f"null_{n}") == 0), F.lit(n)) for n in names]))
    fields = F.array_join(F.slice(filled, 1, 4), ",")
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    row = lambda i, t, p: F.struct(F.lit(i).alias("check_idx"), F.lit(t).alias("type"),
                                   p.alias("parameter"))
    checks = F.array_compact(F.array(
        row(0, "status", F.lit("200")), row(1, "json", F.lit("")),
        row(2, "max_latency", F.lit("20000")),
        F.when(F.col("n") > 0, row(3, "min_rows", half.cast("string"))),
        F.when(F.size(filled) > 0, row(4, "fields_present", fields))))
    return prof.select(F.explode(checks).alias("c")).select("c.*")


def find_row_array(responses: DataFrame, id_col: str, body: str) -> DataFrame:
    """Path and size of the largest array in each document, shallowest first, depth below three.

    Object members are opened three levels deep; of equal arrays the one met first level by level
    wins, then the alphabetically first path.
    """
    doc = responses.select(F.col(id_col), jsonpath.parse(F.col(body)).alias("v")).filter(
        F.col("v").isNotNull())
    level = doc.select(id_col, F.lit("").alias("path"), "v")
    spark = responses.sparkSession
    found = None
    for depth in range(4):
        arr = F.try_variant_get(F.col("v"), "$", "array<variant>")
        hits = level.filter(arr.isNotNull()).select(
            id_col, "path", F.size(arr).alias("size"), F.lit(depth).alias("depth"))
        found = hits if found is None else found.unionByName(hits)
        if depth < 3:
            opened = level.filter(arr.isNull()).withColumnRenamed("v", "_v").lateralJoin(
                spark.tvf.variant_explode(F.col("_v").outer()))
            level = opened.filter(F.col("key").isNotNull()).select(
                id_col,
                F.when(F.col("path") == "", F.col("key")).otherwise(
                    F.concat_ws(".", "path", "key")).alias("path"),
                F.col("value").alias("v"))
    best = found.groupBy(id_col).agg(F.min(F.struct(
        (-F.col("size")).alias("s"), "depth", "path")).alias("b"))
    return best.select(id_col, F.col("b.path").alias("path"), (-F.col("b.s")).alias("size"))


# ------------------------------------------------------------------ ingest checks
def table_schema_drift(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Tables whose ordered column list differs from the saved one; new tables are no change."""
    s = saved.select("table", F.col("columns").alias("previous"))
    return current.join(s, "table").filter(F.col("columns") != F.col("previous")).select(
        "table", "previous", F.col("columns").alias("current"))


def daily_columns(cells: DataFrame, table: str, day: str, column: str) -> DataFrame:
    """Sorted column list of each table and day, from one row per filled cell: table, day, columns.

    The set of names is mergeable, so a busy table is gathered map-side; days and columns bound what is kept.
    """
    return cells.groupBy(F.col(table).alias("table"), F.col(day).alias("day")).agg(
        F.array_sort(F.collect_set(column)).alias("columns"))


def saved_before(daily: DataFrame) -> DataFrame:
    """For each table and day the column list of the last day before it; the first day has none."""
    before = Window.partitionBy("table").orderBy("day")
    return daily.withColumn("columns", F.lag("columns").over(before)).filter(F.col("columns").isNotNull())


def ingest_validation(df: DataFrame, required: Sequence[str], *, low_rows: int = 1000,
                      missing_files: Sequence[str] = ()) -> DataFrame:
    """Status and confidence of one ingested table: files, columns, zero rows, few rows."""
    gone = [c for c in required if c not in df.columns]
    n = F.col("rows")
    status = (
        F.when(F.lit(bool(missing_files)), "VALIDATION_FAILED")
        .when(n == 0, "ZERO_ROWS").when(F.lit(bool(gone)), "VALIDATION_FAILED")
        .when(n < low_rows, "OK_WITH_WARNINGS").otherwise("OK"))
    level = (
        F.when(F.lit(bool(missing_files or gone)) | (n == 0), "none")
        .when(n >= low_rows, "high").otherwise("medium"))
    return df.agg(F.count("*").alias("rows")).select(
        "rows", status.alias("status"), level.alias("confidence"),
        F.lit(",".join(gone)).alias("missing_columns"))


def readiness(sources: DataFrame) -> DataFrame:
    """Ready when there is a network source and every network source answers in shape."""
    network = F.col("kind") == "network"
    ok = F.col("status") == "REACHABLE_SHAPE_OK"
    return sources.agg(
        F.count_if(network).alias("network_sources"), F.count_if(network & ok).alias("ok_sources")
    ).withColumn("ready", (F.col("network_sources") > 0)
                 & (F.col("network_sources") == F.col("ok_sources")))


# ------------------------------------------------------------------ detection
def case_outcomes(checks: DataFrame, expected: DataFrame, key: str = "case_id") -> DataFrame:
    """Per case the expected and actual status, the expected dimension and whether it was flagged.

    ``checks`` are contract results keyed by case, ``expected`` has (key, dimension): the dimension a
    case ought to fail in, NULL for a healthy one.
    """
    g = checks.join(expected, key).groupBy(key, "dimension").agg(
        F.bool_and(F.col("ok") | ~F.col("critical")).alias("success"),
        F.coalesce(F.bool_or(~F.col("ok") & (F.col("check_dimension") == F.col("dimension"))),
                   F.lit(False)).alias("dimension_flagged"))
    return g.select(
        key, F.when(F.col("dimension").isNull(), "verified").otherwise("failed_checks").alias("expected"),
        F.when(F.col("success"), "verified").otherwise("failed_checks").alias("actual"),
        F.col("dimension").alias("dimension_expected"), "dimension_flagged")
