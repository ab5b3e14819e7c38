"""Usage that stays true after pruning: what the next prompt will measure, in place of what the last one did."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.tokens import IMAGE_TOKENS, tokenizer_scale

# How far removed content is credited and added content charged, the final margin, the credit
# of removed signatures and of an image, and the fixed prompt where no record implies it.
REMOVED, ADDED, MARGIN, SIGNATURE, IMAGE, OVERHEAD = 0.8, 0.1, 0.05, 0.6, 0.5, 20_000
COUNTS_SIGNATURES = ["claude-opus-4-6", "claude-opus-4-7", "claude-opus-4-8", "claude-opus-5", "claude-fable-5"]
PARTS = ["tokens", "signature", "images"]


def size(side: str):
    return F.col(f"{side}_tokens") + F.col(f"{side}_signature") + F.col(f"{side}_images") * IMAGE_TOKENS


def window_estimates(records: DataFrame) -> DataFrame:
    """(session_id, start, estimate): the prompt that each session's active window will make.

    ``records``: session_id, msg_idx, boundary, sidechain, model, used (the recorded prompt, or null) and, for ``before`` and ``after``
    the pruning, estimated ``_tokens``, ``_signature`` tokens and ``_images``; with a column ``sent``, only records where
    it is true count, for branches left behind. The window begins after the last boundary. The first record
    after a boundary still measures what was before it and is no evidence. The estimate is the greater of two:
    the last record adjusted by what changed before it with everything after it, and all content with the least
    overhead that any record implies. A session whose window holds no record that counts has no row.
    """
    rows = records.withColumns({f"{s}_{p}": F.coalesce(F.col(f"{s}_{p}"), F.lit(0)).cast("long") for s in ("before", "after") for p in PARTS})
    starts = rows.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("boundary"), F.col("msg_idx") + 1)), F.lit(0)).alias("start"))
    counts = ~F.coalesce(F.col("sidechain"), F.lit(False)) & (F.col("msg_idx") >= F.col("start"))
    if "sent" in records.columns:
        counts = counts & F.coalesce(F.col("sent"), F.lit(False))
    held = rows.join(starts, "session_id").where(counts)
    order = Window.partitionBy("session_id").orderBy("msg_idx")
    prefix = F.sum(size("before")).over(order) - size("before")
    # one response a prompt: records that repeat the size of the one before belong to it
    recorded = F.when(F.col("used") > 0, F.col("used"))
    last = F.last(recorded, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumns({"prefix": prefix, "response": F.when(recorded.isNotNull() & ~recorded.eqNullSafe(last), recorded)})
    first = F.min(F.when(F.col("response").isNotNull(), F.col("msg_idx"))).over(Window.partitionBy("session_id"))
    stale = (F.col("start") > 0) & (F.col("msg_idx") == F.col("first"))
    held = held.withColumn("first", first).withColumn("response", F.when(~stale, F.col("response")))
    is_response = F.col("response").isNotNull()
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    step = held.withColumns({
        "grew": F.col("response") - F.last("response", ignorenulls=True).over(earlier),
        "span": F.when(is_response, F.col("prefix") - F.last(F.when(is_response, F.col("prefix")), ignorenulls=True).over(earlier)),
        "anchor": F.max(F.when(is_response, F.col("msg_idx"))).over(Window.partitionBy("session_id")),
    })
    usable = (F.col("grew") > 0) & (F.col("span") > 0)
    change = {p: F.col(f"after_{p}") - F.col(f"before_{p}") for p in PARTS}
    before_anchor = F.col("msg_idx") < F.col("anchor")
    sums = {}
    for p, d in change.items():  # whole numbers, so that no order of adding matters
        sums[f"less_{p}"] = F.coalesce(F.sum(F.when(before_anchor & (d < 0), d)), F.lit(0))
        sums[f"more_{p}"] = F.coalesce(F.sum(F.when(before_anchor & (d > 0), d)), F.lit(0))
    named = F.when(F.col("model").isNotNull() & (F.col("model") != "<synthetic>"), F.col("msg_idx"))
    whole = step.groupBy("session_id", "start").agg(
        F.max_by("model", named).alias("model"), F.count("response").alias("responses"), F.max_by("response", F.when(is_response, F.col("msg_idx"))).alias("recorded"),
        F.min(F.when(is_response, F.greatest(F.col("response") - F.col("prefix"), F.lit(0)))).alias("overhead"), F.sum(size("after")).alias("content"),
        F.coalesce(F.sum(F.when(~before_anchor, size("after"))), F.lit(0)).alias("tail"),
        F.coalesce(F.sum(F.when(usable, F.col("span"))), F.lit(0)).alias("est"), F.coalesce(F.sum(F.when(usable, F.col("grew"))), F.lit(0)).alias("rec"), *[c.alias(n) for n, c in sums.items()],
    )
    model = F.coalesce("model", F.lit(""))
    measured = ~F.contains(F.lower(model), F.lit("claude-")) & (F.col("responses") >= 2) & (F.col("est") >= 128) & (F.col("rec") > 0)
    scale = F.when(measured, F.greatest(F.least(F.col("est") / F.col("rec"), F.lit(2.5)), F.lit(0.5))).otherwise(tokenizer_scale(model))
    credit = {"tokens": F.lit(1.0), "signature": F.when(model.isin(COUNTS_SIGNATURES), F.lit(SIGNATURE)).otherwise(F.lit(0.0)), "images": F.lit(IMAGE * IMAGE_TOKENS)}
    charge = {"tokens": 1, "signature": 1, "images": IMAGE_TOKENS}
    anchored = F.col("recorded") + F.col("tail") * (1.0 + ADDED)
    for p in PARTS:
        anchored = anchored + F.col(f"less_{p}") * credit[p] * REMOVED / F.col("scale") + F.col(f"more_{p}") * charge[p] * (1.0 + ADDED)
    outright = (F.coalesce("overhead", F.lit(OVERHEAD)) + F.col("content")) / F.col("scale")
    scaled = whole.withColumn("scale", scale)
    return scaled.select("session_id", "start", F.ceil(F.greatest(outright, F.coalesce(anchored, outright)) * (1.0 + MARGIN)).cast("long").alias("estimate"))


def revive(records: DataFrame) -> DataFrame:
    """``records`` with ``used`` in the active window lowered to the estimate where it is above it, and ``orig_used``, what it replaced.

    Records of side chains, and those before the window, stay as they are. Null and zero usage stays.
    """
    found = window_estimates(records)
    both = records.join(found, "session_id", "left")
    over = ~F.coalesce(F.col("sidechain"), F.lit(False)) & (F.col("msg_idx") >= F.col("start")) & (F.col("used") > F.col("estimate"))
    over = F.coalesce(over, F.lit(False))
    return both.select(*[c for c in records.columns if c != "used"], F.when(over, F.col("estimate")).otherwise(F.col("used")).alias("used"), F.when(over, F.col("used")).alias("orig_used"))
