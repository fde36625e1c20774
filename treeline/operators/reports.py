"""E1 output: display groups, numbering, rollups, JSON documents, text.

The reference renders one document per repository holding every proposal.
Here that document comes in ordered chunks of bounded size (``document_chunks``), so no
repository's proposals are ever gathered into a single row; the header alone
(counts by action and by risk) and one JSON record per proposal are tables of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import constants as K
from treeline.functions import rules as R
from treeline.functions.text import fmt
from treeline.operators.ordering import before, number_within


def with_display_group(proposals: DataFrame) -> DataFrame:
    """P16."""
    g = R.display_group(F.col("source"))
    return proposals.withColumns({"display_group": g, "group_rank": R.group_rank(g)})


def proposal_numbers(proposals: DataFrame) -> DataFrame:
    """Running number in display order (group order, then proposal order)."""
    p = with_display_group(proposals)
    return number_within(p, ["repo_id"], [F.col("group_rank"), F.col("phase"), F.col("ord")],
                         name="number")


def proposal_rollup(proposals: DataFrame) -> DataFrame:
    """Counts by action, by risk, by display group and in total.

    One aggregation with GROUPING SETS; ``dimension`` names the set and
    ``value`` the key (null for the total).
    """
    p = with_display_group(proposals)
    g = p.groupingSets(
        [["repo_id"], ["repo_id", "action"], ["repo_id", "risk"], ["repo_id", "display_group"]],
        "repo_id", "action", "risk", "display_group",
    ).agg(F.count(F.lit(1)).alias("n"),
          F.grouping_id().alias("gid"))
    dim = (F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "action")
           .when(F.col("gid") == 5, "risk").otherwise("display_group"))
    val = F.coalesce(F.col("action"), F.col("risk"), F.col("display_group"))
    return g.select("repo_id", dim.alias("dimension"), val.alias("value"), "n")


def _count_map(proposals: DataFrame, key: str) -> DataFrame:
    counts = proposals.groupBy("repo_id", key).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("repo_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n")))))
         .alias(f"by_{key}"))


def proposals_document(proposals: DataFrame) -> DataFrame:
    """A10 header: total and the by_action / by_risk summary (keys sorted).

    The maps have at most three keys each, so the per-repository collect is
    bounded.
    """
    total = proposals.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_proposals"))
    doc = (total.join(_count_map(proposals, "action"), "repo_id")
           .join(_count_map(proposals, "risk"), "repo_id"))
    header = F.to_json(F.struct(
        F.col("total_proposals"),
        F.struct(F.col("by_action"), F.col("by_risk")).alias("summary")))
    return doc.select("repo_id", "total_proposals", header.alias("document"))


CHUNK_BYTES = 1 << 20


def _json(value: F.Column) -> F.Column:
    """A string as a JSON literal."""
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _open(json: F.Column) -> F.Column:
    """A JSON object without its closing brace."""
    return F.substring(json, F.lit(1), F.length(json) - 1)


def document_pieces(proposals: DataFrame, members: DataFrame, repo_list: DataFrame) -> DataFrame:
    """A10 cut into texts: (repo_id, phase, ord, part, position, piece), whose concatenation in
    that order is the repository's document.

    A header, one piece per proposal in proposal order, a footer with the summary. A
    duplicate flag is a piece before its members, one for each member (``all_duplicates``)
    and one after them.
    """
    first = proposals.groupBy("repo_id").agg(F.min(F.struct("phase", "ord")).alias("first"))
    counts = proposals.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    for key in ("action", "risk"):
        counts = counts.join(_count_map(proposals, key), "repo_id")
    per_repo = repo_list.select("repo_id").join(counts, "repo_id", "left")
    ord_type = proposals.schema["ord"].dataType  # a number, or a walk key
    at = lambda phase, ord_, part, position: (
        F.lit(phase).cast("int").alias("phase") if isinstance(phase, int) else phase.cast("int").alias("phase"),
        ord_.cast(ord_type).alias("ord"), F.lit(part).alias("part"), position.cast("bigint").alias("position"))
    zero, none = F.lit(0), F.lit(None)
    header = per_repo.select("repo_id", *at(0, none, 0, zero), F.concat(
        F.lit('{"total_proposals":'), F.coalesce("total", F.lit(0)).cast("string"),
        F.lit(',"proposals":[')).alias("piece"))
    summary = [F.coalesce(F.to_json(f"by_{k}"), F.lit("{}")) for k in ("action", "risk")]
    footer = per_repo.select("repo_id", *at(9, none, 0, zero), F.concat(
        F.lit('],"summary":{"by_action":'), summary[0], F.lit(',"by_risk":'), summary[1],
        F.lit("}}")).alias("piece"))
    d = F.col("details")
    p = proposals.join(first, "repo_id").withColumn("_dup", F.col("phase") == 2)
    comma = F.when(F.struct("phase", "ord") == F.col("first"), F.lit("")).otherwise(F.lit(","))
    head = F.concat(comma, _open(F.to_json(F.struct("action", "source", "target", "reason", "risk"),
                                           {"ignoreNullFields": "false"})), F.lit(',"details":'))
    body = F.when(F.col("_dup"), F.concat(
        _open(F.to_json(F.struct(d["total_count"].alias("total_count"), d["examples"].alias("examples")))),
        F.lit(',"all_duplicates":['))).otherwise(F.concat(F.to_json(d), F.lit("}")))
    starts = p.select("repo_id", *at(F.col("phase"), F.col("ord"), 0, zero), F.concat(head, body).alias("piece"))
    listed = members.select("repo_id", *at(2, F.col("ord"), 1, F.col("position")), F.concat(
        F.when(F.col("position") == 1, F.lit("")).otherwise(F.lit(",")),
        _json(F.col("relative_path"))).alias("piece"))
    rest = F.when(d["remaining"].isNotNull(), F.concat(F.lit(',"remaining":'), _json(d["remaining"])))
    ends = p.filter("_dup").select("repo_id", *at(F.col("phase"), F.col("ord"), 2, zero), F.concat(
        F.lit("]"), F.coalesce(rest, F.lit("")), F.lit("}}")).alias("piece"))
    return header.unionByName(starts).unionByName(listed).unionByName(ends).unionByName(footer)


def document_chunks(proposals: DataFrame, members: DataFrame, repo_list: DataFrame,
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A10: every repository's document with its proposals, in chunks of about ``chunk_bytes``:
    (repo_id, chunk_no, n_bytes, text). The texts in order of chunk_no are one JSON document.

    A piece belongs to the chunk in which it begins, by its running byte offset over range
    slices; only the pieces of one chunk are ever brought together. A number is left out
    where no piece begins.
    """
    order = ["phase", "ord", "part", "position"]
    pieces = document_pieces(proposals, members, repo_list).withColumn("_bytes", F.octet_length("piece"))
    placed = before(pieces, ["repo_id"], order, {"_at": ("sum", "_bytes")}).withColumn(
        "chunk_no", F.floor(F.col("_at") / chunk_bytes).cast("bigint"))
    texts = F.array_sort(F.collect_list(F.struct(*order, "piece")))
    return placed.groupBy("repo_id", "chunk_no").agg(
        F.sum("_bytes").cast("bigint").alias("n_bytes"),
        F.array_join(F.transform(texts, lambda x: x["piece"]), "").alias("text"))


def proposal_records(proposals: DataFrame) -> DataFrame:
    """S3 / A10 body: one JSON record per proposal, nulls kept."""
    rec = F.struct("action", "source", "target", "reason", "risk", "details")
    return proposals.select("repo_id", "phase", "ord",
                            F.to_json(rec, {"ignoreNullFields": "false"}).alias("record"))


def proposal_text(proposals: DataFrame) -> DataFrame:
    """How one proposal prints (duplicate flags list examples + remaining)."""
    d = F.col("details")
    examples = F.concat(
        F.array(F.lit(K.PROPOSAL_EXAMPLES)),
        F.transform(d["examples"], lambda e: fmt(K.PROPOSAL_EXAMPLE, path=e)),
        F.array_compact(F.array(F.when(d["remaining"].isNotNull(),
                                       fmt(K.PROPOSAL_REMAINING, remaining=d["remaining"])))))
    plain = F.array_compact(F.array(*[
        F.when(d[key].isNotNull(), fmt(K.PROPOSAL_DETAIL, key=key, value=d[key]))
        for key in ("category", "current_location", "suggestion")]))
    detail_lines = F.when(d["examples"].isNotNull(), examples).otherwise(plain)
    head = F.array_compact(F.array(
        fmt(K.PROPOSAL_HEAD, ACTION=F.upper("action"), source=F.col("source")),
        F.when(F.col("target").isNotNull(), fmt(K.PROPOSAL_TARGET, target=F.col("target"))),
        fmt(K.PROPOSAL_REASON, reason=F.col("reason")),
        fmt(K.PROPOSAL_RISK, RISK=F.upper("risk"))))
    return proposals.select("repo_id", "phase", "ord",
                            F.array_join(F.concat(head, detail_lines), "\n").alias("text"))


GROUP_ORDER = K.GROUP_ORDER
