"""One run of the graph build: mode, queue, extraction, clearing, writing, index and summary, as whole-table DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.functions import constants as K
from corvana.operators import boilerplate as B
from corvana.operators import graph as G
from corvana.operators import ner as N
from corvana.session import stored

#: Tables by the names that `graph.build` gives their new rows.
TABLES = {"links": "article_graph", "relations": "entity_relations", "attributes": "entity_attributes"}


def run(articles: DataFrame, tables: dict[str, DataFrame], lexicon: dict[str, list[str]] | None = None, stored_signature: str | None = None, full: bool = False, graph_types: list[str] | None = None) -> dict:
    """{mode, signature, tables, summary} after one run over `tables` (graph_entities, article_graph, entity_relations,
    entity_attributes, article_graph_index).

    Only queued articles are read and extracted, and only their derived rows are replaced; nodes stay. Running again over
    unchanged articles with the stored signature processes none; a changed signature builds everything anew. Articles that
    are delivered several times count once; null contents are skipped."""
    signature = G.rules_signature(lexicon)
    derived = {n: tables[n] for n in G.DERIVED}
    mode = G.build_mode(full, stored_signature, signature, not tables["article_graph"].isEmpty())
    one = articles.where("id is not null").dropDuplicates(["id"])
    if mode == "reset":
        derived = G.reset(derived)
    elif mode == "backfill":
        known = G.backfill(one, tables["article_graph"], tables["entity_relations"], tables["entity_attributes"]).withColumn("extractor_signature", F.lit(signature))
        derived["article_graph_index"] = known.select([c.split()[0] for c in G.INDEX.split(", ")])
    todo = stored(G.queue(one, derived["article_graph_index"], signature).select("id", "title", "content", "source", "hash"), "queue")
    texts = todo.select("id", B.extraction_text(F.col("title"), F.col("content"), F.col("source")).alias("text"))
    x = stored(N.extract_all(texts, "id", "text", lexicon), "extracted").withColumnRenamed("id", "article_id")
    inline = lambda c: x.select("article_id", F.inline(c))
    built = {n: stored(t, n) for n, t in G.build(inline("entities"), inline("relations"), inline("attributes"), tables["graph_entities"], graph_types or list(K.GRAPH_TYPES)).items()}
    left = G.clear(derived, todo.select(F.col("id").alias("article_id")))
    after = {"graph_entities": tables["graph_entities"].select("id", "name", "type").unionByName(built["entities"])}
    for name, table in TABLES.items():
        rows = built[name]
        after[table] = left[table].select(rows.columns).unionByName(rows)
    index = G.index_rows(todo, built, signature)
    after["article_graph_index"] = left["article_graph_index"].select(index.columns).unionByName(index)
    summary = todo.agg(F.count(F.lit(1)).alias("processed")).select(F.lit(mode).alias("mode"), "processed")
    for name, rows in built.items():
        summary = summary.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("new_" + name))))  # one row each
    return {"mode": mode, "signature": signature, "tables": after, "summary": summary}
