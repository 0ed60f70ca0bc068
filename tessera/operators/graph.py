"""Evidence graphs as node and edge tables, keyed by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions.text import claim_type, display_label, judged_relation
from tessera.operators.tables import checkpoint

# Relations of evidence, and those that keep a claim within one hop.
EVIDENCE = ["METHOD", "BACKGROUND", "RESULT_COMPARISON", "supports", "hop_evidence"]
SINGLE_HOP = ["METHOD", "BACKGROUND", "RESULT_COMPARISON", "supports"]


def first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key: the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def base_nodes(documents: DataFrame) -> DataFrame:
    """Paper and chunk nodes, cited papers included.

    documents: (query_id, chunk_uid, paper_id, text, cites array<struct<paper_id,intent>>).
    """
    chunk = documents.select("query_id", F.col("chunk_uid").alias("node_id"), F.lit("chunk").alias("node_type"))
    paper = documents.select("query_id", F.col("paper_id").alias("node_id"), F.lit("paper").alias("node_type"))
    cited = documents.select("query_id", F.explode("cites.paper_id").alias("node_id"), F.lit("paper").alias("node_type"))
    return chunk.unionByName(paper).unionByName(cited).where("node_id IS NOT NULL AND node_id != ''").distinct()


def base_edges(documents: DataFrame) -> DataFrame:
    """CHUNK_OF edges, and one from a chunk to each paper that it cites, by the first citation's intent."""
    of = documents.select("query_id", F.col("chunk_uid").alias("src"), F.col("paper_id").alias("dst"), F.lit("CHUNK_OF").alias("relation")).distinct()
    cites = documents.select("query_id", F.col("chunk_uid").alias("src"), F.posexplode("cites").alias("pos", "c")).select("query_id", "src", "pos", F.col("c.paper_id").alias("dst"), F.coalesce("c.intent", F.lit("BACKGROUND")).alias("relation"))
    cites = first(cites.where("dst IS NOT NULL AND dst != ''"), ["query_id", "src", "dst"], ["pos"]).drop("pos")
    return of.unionByName(cites)


def claim_id(text: Column) -> Column:
    return F.concat(F.lit("claim:"), F.substring(F.sha1(F.concat(F.lit("claim:"), text)), 1, 12))


def claims(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claim nodes, of the first chunk's attributes, and one edge a claim and chunk, of the last label.

    items: (query_id, pos, chunk_uid, type, text, subtype, label).
    """
    good = items.where((F.col("type") == "claim") & (F.trim(F.coalesce("text", F.lit(""))) != "")).withColumn("claim_id", claim_id(F.col("text")))
    known = F.when(F.col("label").isin(*EVIDENCE[:3]), F.col("label")).otherwise("BACKGROUND")
    nodes = first(good, ["query_id", "claim_id"], ["pos"]).select("query_id", "claim_id", "text", "subtype", "chunk_uid", claim_type(F.col("text")).alias("claim_type"))
    edges = first(good.withColumn("relation", known), ["query_id", "claim_id", "chunk_uid"], [F.desc("pos")]).select("query_id", F.col("claim_id").alias("src"), F.col("chunk_uid").alias("dst"), "relation")
    return nodes, edges


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges whose ends both have an edge in and one out, by dropping others again and again."""
    now, n = checkpoint(edges), -1
    while n != (n := now.count()) and n:
        into, out = now.select("query_id", F.col("dst").alias("src")).distinct(), now.select("query_id", F.col("src").alias("dst")).distinct()
        now = checkpoint(now.join(into, ["query_id", "src"], "left_semi").join(out, ["query_id", "dst"], "left_semi"))
    return now


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(query_id, node_id) on a cycle of evidence relations.

    Nodes without an edge in or out are peeled off. In what is left, the greatest node that
    leads to each node is its colour, and the nodes that lead back to a colour's own node
    within the colour are one strongly connected component. Components are taken off until
    nothing is left. Every step is a row a node, never a row a pair of nodes.
    """
    now = _peeled(edges.where(F.col("relation").isin(*EVIDENCE)).select("query_id", "src", "dst").distinct())
    found = now.where("src = dst").select("query_id", F.col("src").alias("node_id"))
    while not now.isEmpty():
        nodes = now.select("query_id", F.col("src").alias("node")).distinct()
        colour, moved = checkpoint(nodes.withColumn("c", F.col("node"))), 1
        while moved:
            came = now.join(colour.withColumnRenamed("node", "src"), ["query_id", "src"]).groupBy("query_id", F.col("dst").alias("node")).agg(F.max("c").alias("m"))
            new = checkpoint(colour.join(came, ["query_id", "node"], "left").select("query_id", "node", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.col("m") > F.col("c")).alias("up")))
            colour, moved = new.select("query_id", "node", "c"), new.where("up").count()
        same = now.join(colour.withColumnRenamed("node", "src"), ["query_id", "src"]).join(colour.select("query_id", F.col("node").alias("dst"), "c"), ["query_id", "dst", "c"])
        same = checkpoint(same.select("query_id", "src", "dst", "c"))
        members = checkpoint(colour.where("node = c"))
        front = members
        while not front.isEmpty():
            back = same.join(front.select("query_id", F.col("node").alias("dst")), ["query_id", "dst"]).select("query_id", F.col("src").alias("node"), "c").distinct()
            front = checkpoint(back.join(members, ["query_id", "node"], "left_anti"))
            members = checkpoint(members.unionByName(front))
        large = members.groupBy("query_id", "c").agg(F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(members.join(large, ["query_id", "c"], "left_semi").select("query_id", F.col("node").alias("node_id")))
        gone = members.select("query_id", F.col("node").alias("src"))
        now = _peeled(now.join(gone, ["query_id", "src"], "left_anti").join(gone.withColumnRenamed("src", "dst"), ["query_id", "dst"], "left_anti"))
    return found.distinct()


def evidence_trail(claims_of: DataFrame, edges: DataFrame, kinds: DataFrame, depth: int = 5, most: int = 5) -> DataFrame:
    """(query_id, claim_id, node_id, depth, relation): chunks reached from a claim, nearest first.

    A walk goes on only from chunk to chunk, and only for a claim that has fewer than
    ``most`` chunks: what is farther away would not be among them. kinds: (query_id, node_id, node_type).
    """
    keys = ["query_id", "claim_id"]
    chunk = kinds.where("node_type = 'chunk'").select("query_id", F.col("node_id").alias("dst")).distinct()
    step = checkpoint(edges.where(F.col("relation").isin(*EVIDENCE)).join(chunk, ["query_id", "dst"], "left_semi").select("query_id", F.col("src").alias("at"), "dst", "relation"))
    front = claims_of.select(*keys, F.col("claim_id").alias("at"))
    seen = None
    for d in range(1, depth + 1):
        new = front.join(step, ["query_id", "at"]).groupBy(*keys, F.col("dst").alias("node_id")).agg(F.min("relation").alias("relation")).withColumn("depth", F.lit(d))
        if seen is not None:
            new = new.join(seen.select(*keys, "node_id"), [*keys, "node_id"], "left_anti")
        new = checkpoint(new)  # what the next level joins
        seen = new if seen is None else seen.unionByName(new)
        few = seen.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") < most)
        front = new.join(few, keys, "left_semi").select(*keys, F.col("node_id").alias("at"))
        if d < depth and front.isEmpty():
            break
    w = Window.partitionBy(*keys).orderBy("depth", "node_id")
    return seen.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def trail_texts(trail: DataFrame, chunks: DataFrame, most: int = 400) -> DataFrame:
    """A trail with the first ``most`` characters of each chunk's text; empty where it has none. chunks: (node_id, text)."""
    known = chunks.select("node_id", F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, most).alias("text"))
    return trail.join(known, "node_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def hop_depth(claim_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``multi`` if an edge out of a claim is of another relation, or leads to a claim; else ``single``."""
    odd = ~F.col("relation").isin(*SINGLE_HOP) | F.col("dst").startswith("claim:")
    out = edges.groupBy("query_id", F.col("src").alias("claim_id")).agg(F.bool_or(odd).alias("odd"))
    return claim_nodes.select("query_id", "claim_id").join(out, ["query_id", "claim_id"], "left").select("query_id", "claim_id", F.when(F.coalesce("odd", F.lit(False)), "multi").otherwise("single").alias("hop_depth"))


def verdicts(evidence: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Blended scores and verdict of each claim. evidence: (claim_id, entails, contradicts, neutral) a chunk, nulls without any."""
    agg = evidence.groupBy(*(keys or ["claim_id"])).agg(
        scores.evidence_blend(F.col("entails")).alias("entail"), scores.evidence_blend(F.col("contradicts")).alias("contradict"), F.count("entails").alias("n_evidence")
    )
    return agg.withColumn("verdict", scores.verdict(F.col("entail"), F.col("contradict"), F.col("n_evidence") > 0))


def route(judged: DataFrame) -> DataFrame:
    """Who decides: a contradiction or several hops go to the language model, as does what entailment leaves open.

    judged: (claim_id, hop_depth, has_conflict, verdict).
    """
    direct = F.coalesce(F.col("has_conflict"), F.lit(False)) | (F.col("hop_depth") == "multi")
    return judged.withColumn("route", F.when(direct, "llm").when(F.col("verdict").isin("Neutral", "Not-Supported"), "nli_then_llm").otherwise("nli"))


def judged_edges(decided: DataFrame, claim_nodes: DataFrame) -> DataFrame:
    """An edge from each claim to its chunk that names the verdict."""
    return decided.join(claim_nodes, ["query_id", "claim_id"]).select("query_id", F.col("claim_id").alias("src"), F.col("chunk_uid").alias("dst"), judged_relation(F.col("verdict")).alias("relation"))


def hop_outcome(eligible: Column, resolved: Column, found: Column, place: Column, budget: int = 50) -> Column:
    """What came of a claim's wish to look further."""
    return F.when(~eligible, "not_needed").when(place > budget, "over_budget").when(~resolved, "unresolved").when(~found, "nothing_found").otherwise("expanded")


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows for a graph viewer: nodes and edges under one schema."""
    n = nodes.select("query_id", F.lit("node").alias("group"), F.col("node_id").alias("id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.col("node_type").alias("label"))
    e = edges.select("query_id", F.lit("edge").alias("group"), F.concat_ws("->", "src", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("label"))
    return n.unionByName(e)


def scorecard(documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of a query's documents, papers, nodes and edges, and its scores' greatest and mean."""
    d = documents.groupBy("query_id").agg(F.count("*").alias("n_documents"), F.count_distinct("paper_id").alias("n_papers"), F.round(F.max("score"), 4).alias("score_max"), F.round(F.avg("score"), 4).alias("score_mean"))
    n = nodes.groupBy("query_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("node_type") == "claim").alias("n_claims"))
    e = edges.groupBy("query_id").agg(F.count("*").alias("n_edges"))
    return d.join(n, "query_id", "left").join(e, "query_id", "left").fillna(0, ["n_nodes", "n_claims", "n_edges"])


def stage_papers(hits: DataFrame) -> DataFrame:
    """A query's papers with their chunks counted, in order of first appearance. hits: (query_id, rank, paper_id)."""
    found = hits.groupBy("query_id", "paper_id").agg(F.count("*").alias("n_chunks"), F.min("rank").alias("first_rank"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank", "paper_id")))


def direct_evidence(claim_edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, claim_id, chunk_uid, text) of the chunks that a claim's evidence edges lead to."""
    step = claim_edges.where(F.col("relation").isin(*EVIDENCE)).select("query_id", F.col("src").alias("claim_id"), F.col("dst").alias("chunk_uid")).distinct()
    return step.join(chunks.select("chunk_uid", "text"), "chunk_uid")


def flat_nodes(hits: DataFrame) -> DataFrame:
    """The nodes of a graph without edges: one a retrieved chunk."""
    return hits.select("query_id", F.col("chunk_uid").alias("node_id"), F.lit("chunk").alias("node_type"), "text")


def best_citation(cited: DataFrame) -> DataFrame:
    """Each claim's citation of the greatest alignment, the first among equals. cited: (claim_id, link_pos, alignment, ...)."""
    return first(cited, ["claim_id"], [F.desc_nulls_last("alignment"), F.asc("link_pos")])


def route_by(mode: str, contradicted: Column, multi_hop: Column) -> Column:
    """Who judges a claim: ``full`` sends contradictions and multi-hop claims to the model, ``nli``, ``llm`` and ``none`` send all one way."""
    if mode not in ("full", "nli", "llm", "none"):
        raise ValueError(f"no such mode of judging: {mode}")
    return F.when(contradicted | multi_hop, "llm").otherwise("nli") if mode == "full" else F.lit(mode)


def viewer_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as a viewer shows them: a label, a short id, at most 800 characters of text on one line, a rounded score.

    nodes: (query_id, node_id, node_type, text, paper_id, section, chunk_index, score).
    """
    node, line = F.col("node_id"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    short = F.concat(F.substring(node, 1, 32), F.when(F.length(node) > 32, "…").otherwise(""))
    return nodes.select(
        "query_id", "node_id", F.col("node_type").alias("type"),
        display_label(F.col("node_type"), node, F.col("text"), F.col("paper_id"), F.col("section"), F.col("chunk_index")).alias("label"),
        F.when(F.col("node_type") == "paper", F.coalesce(F.nullif("paper_id", F.lit("")), node)).otherwise(short).alias("display_id"),
        F.substring(line, 1, 800).alias("full_text"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"),
    )


def viewer_edges(edges: DataFrame) -> DataFrame:
    """Edges as a viewer shows them; those without a relation are ``related``. edges: (query_id, src, dst, relation, score)."""
    kind = F.coalesce(F.nullif("relation", F.lit("")), F.lit("related"))
    return edges.select("query_id", F.col("src").alias("source"), F.col("dst").alias("target"), kind.alias("relation"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"))


def tallies(nodes: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, kind, bucket, n): a query's nodes by type, its claims by verdict and by who judged them; ``?`` if not said.

    nodes: (query_id, node_type); judged: (query_id, verdict, verifier).
    """
    by = lambda df, kind, c: df.select("query_id", F.lit(kind).alias("kind"), F.coalesce(c, F.lit("?")).alias("bucket"))
    each = by(nodes, "node_type", "node_type").unionByName(by(judged, "verdict", "verdict")).unionByName(by(judged, "verifier", "verifier"))
    return each.groupBy("query_id", "kind", "bucket").agg(F.count("*").alias("n"))
