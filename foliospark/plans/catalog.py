"""The engine's queries: (spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import embedders
from foliospark.functions import text, vectors, wordpiece
from foliospark.operators import answers, index, judge, key_numbers, keywords, search, tree
from foliospark.plans import corpus, files, pipeline
from foliospark.shared import shared_path
from foliospark.sources import archive, html, markdown, pdf


def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.build_tree(corpus.sections(spark, sf_dir)).select("doc_id", "sec_idx", "level", "depth", "parent_idx", "id", "parent_id", "token_count")


def section_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.children(tree.build_tree(corpus.sections(spark, sf_dir)))
    return rows.select("doc_id", "sec_idx", F.size("children").alias("n_children"), F.array_join("children", " ").alias("children"))


def table_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    rows = F.array(cells, F.slice(cells, 1, 1), F.concat(cells, cells))
    t = corpus.table(spark, sf_dir, "part").select("p_partkey", rows.alias("rows"), F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("headers"))
    return t.select("p_partkey", F.array_join(F.transform(tree.fit_rows(F.col("rows"), F.col("headers")), lambda r: F.array_join(r, "|")), "/").alias("fitted"))


def keywords_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sections(spark, sf_dir).select("doc_id", "sec_idx", F.array_join(keywords.keywords(F.col("title"), F.col("text")), " ").alias("keywords"))


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = key_numbers.figures(corpus.figure_lines(spark, sf_dir))
    return rows.select("doc_id", "line", "raw", "kind", "label", F.round(key_numbers.parse_number(F.col("raw")), 6).alias("value"))


def key_numbers_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_numbers.key_numbers(corpus.figure_lines(spark, sf_dir), limit=6).select("doc_id", "kn_idx", "label", "value", "unit")


def doc_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/in/"), "p_brand", F.lit("_"), F.initcap("p_name"), F.col("p_size").cast("string"), F.lit("b.v2.Csv"))
    return corpus.table(spark, sf_dir, "part").select("p_partkey", text.doc_slug(path).alias("slug"), text.filename_title(text.stem(path)).alias("title"))


def source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = corpus.table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("C:\\docs\\"), F.regexp_replace("url", "[^a-z.]+", "_"), F.lit("//"))).otherwise(F.concat(F.lit("/srv/"), F.regexp_replace("url", "://", "/")))
    return urls.select("page_id", text.source_label(path).alias("label"))


def retrieval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.exchanges(spark, sf_dir)
    return rows.select("conv_id", "turn", F.array_join(text.retrieval_tokens(F.col("question")), " ").alias("tokens"), F.array_join(text.query_units(F.col("question")), " ").alias("units"))


def postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_frequency(corpus.sections(spark, sf_dir))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.postings(corpus.sections(spark, sf_dir))
    return rows.groupBy("doc_id", "sec_idx", "col").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("sum_positions"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = search.bm25(corpus.sections(spark, sf_dir), corpus.questions(spark), scope="corpus", stem=None)
    return search.ranked(scores, 24).select("qid", "doc_id", "sec_idx", "rank", F.round("score", 6).alias("score"))


def bm25_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = search.bm25(corpus.sections(spark, sf_dir), corpus.questions(spark), stem=None)
    return search.ranked(scores, search.TOP_K, "qid", "doc_id").select("qid", "doc_id", "sec_idx", "rank", F.round("score", 6).alias("score"))


def _first_vectors(vecs: DataFrame) -> DataFrame:
    return vecs.groupBy("doc_id").agg(F.min_by("vec", "sec_idx").alias("vec")).select(F.col("doc_id").cast("bigint").alias("qid"), "doc_id", "vec")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = corpus.vectors(spark, sf_dir)
    scores = search.dense(vecs, _first_vectors(vecs)).withColumn("score", F.round("score", 9))
    return search.ranked(scores, 24).select("qid", "doc_id", "sec_idx", "rank", F.round("score", 6).alias("score"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with 40 components of the next, so that lengths differ."""
    v = corpus.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("n_"), F.slice("embedding", 1, 40).alias("other"))
    return v.join(nxt, F.expr("vec_id = n_")).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 0.3: no pair of these tables reaches the usual 0.68."""
    return index.semantic_edges(corpus.vectors(spark, sf_dir), 0.3).select("doc_id", "from_idx", "to_idx", F.round("weight", 6).alias("weight"))


def structural_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.structural_edges(tree.build_tree(corpus.sections(spark, sf_dir)))


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of each document's lines: by length, and by their number of commas."""
    rows = corpus.sections(spark, sf_dir)
    made = lambda c: search.ranked(rows.select(F.col("doc_id").alias("qid"), "doc_id", "sec_idx", c.cast("double").alias("score")), 24)
    return made(F.length("text")), made(F.length("text") - F.length(F.translate("text", ",", "")))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _lists(spark, sf_dir)
    return search.fuse({search.BM25_WEIGHT: a, search.DENSE_WEIGHT: b}).select("qid", "sec_idx", F.round("score", 9).alias("score"))


def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _lists(spark, sf_dir)
    fused = search.fuse({search.BM25_WEIGHT: a.filter("rank < 3")})
    return search.expand(fused, structural_edges(spark, sf_dir)).select("qid", "sec_idx", F.round("score", 9).alias("score"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best sections for its own question, the title of its second line."""
    rows = corpus.sections(spark, sf_dir)
    asked = rows.filter("sec_idx = 1").select(F.col("doc_id").alias("qid"), "doc_id", F.col("title").alias("question"))
    edges = index.structural_edges(tree.build_tree(rows))
    return search.hybrid(rows, asked, edges, stem=None).select("qid", "sec_idx", "rank", F.round("score", 6).alias("score"))


def porter_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = search.bm25(corpus.sections(spark, sf_dir), corpus.questions(spark), scope="corpus")
    return search.ranked(scores, 24).select("qid", "doc_id", "sec_idx", "rank", F.round("score", 6).alias("score"))


def _stored(spark: SparkSession, sf_dir: str) -> index.StoredIndex:
    """An index of all documents in three segments: every third document replaced after it was there with other text, every seventh forgotten."""
    built = tree.build_tree(corpus.sections(spark, sf_dir))
    out = index.StoredIndex(spark, shared_path(spark, "index"))
    third = F.col("doc_id") % 3 == 0
    out.add(built.withColumn("text", F.when(third, F.lit("thatin thatin rewh replaced")).otherwise(F.col("text"))))
    out.add(built.filter(third))
    out.forget(built.filter(F.col("doc_id") % 7 == 0).select("doc_id").distinct())
    return out


def stored_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed BM25 that is read from the stored postings."""
    scores = search.bm25(_stored(spark, sf_dir), corpus.questions(spark), scope="corpus")
    return search.ranked(scores, 24).select("qid", "doc_id", "sec_idx", "rank", F.round("score", 6).alias("score"))


def stored_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored index holds of each document after replacing some and forgetting some."""
    stored = _stored(spark, sf_dir)
    return index.index_stats(stored.registry(), stored.edges()).select("doc_id", "n_sections", "n_edges")


def stemmed_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hybrid_topk with stems, as it is by default."""
    rows = corpus.sections(spark, sf_dir)
    asked = rows.filter("sec_idx = 1").select(F.col("doc_id").alias("qid"), "doc_id", F.col("title").alias("question"))
    return search.hybrid(rows, asked, index.structural_edges(tree.build_tree(rows))).select("qid", "sec_idx", "rank", F.round("score", 6).alias("score"))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest lines of each document ranked anew by a stand-in scorer: how near their length is to that of the question."""

    def near(question, passage):
        return -(question.str.len() - passage.str.len()).abs().astype("float64")

    rows = corpus.sections(spark, sf_dir)
    first, _ = _lists(spark, sf_dir)
    asked = rows.filter("sec_idx = 1").select(F.col("doc_id").alias("q_"), F.col("text").alias("question"))
    hits = first.join(rows.select(F.col("doc_id").alias("d_"), F.col("sec_idx").alias("s_"), F.col("text").alias("passage")), F.expr("doc_id = d_ AND sec_idx = s_")).join(asked, F.expr("qid = q_"))
    return search.rerank(hits, near).select("qid", "sec_idx", "rank", "score")


def embedded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of length one by a stand-in model that counts characters, blanks and the letter a."""
    vecs = embedders.embed_sections(corpus.sections(spark, sf_dir), lambda texts: [[len(t), t.count(" "), t.count("a")] for t in texts])
    part = lambda i: F.round(F.get("vec", F.lit(i)).cast("double"), 5)
    return vecs.select("doc_id", "sec_idx", part(0).alias("x"), part(1).alias("y"), part(2).alias("z"))


def key_numbers_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come with key numbers keep them; the others' are found."""
    rows = corpus.figure_lines(spark, sf_dir).withColumn("id", F.lit("§1"))
    present = corpus.table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("kn_idx"), F.lit("§1").alias("section"), F.lit("Size").alias("label"), F.col("p_size").cast("string").alias("value"), F.lit(None).cast("string").alias("unit"))
    return pipeline.document_key_numbers(rows, 64, present).select("doc_id", "kn_idx", "section", "label", "value", "unit")


def query_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.exchanges(spark, sf_dir)
    none = F.array().cast("array<string>")
    return rows.select("conv_id", "turn", F.round(answers.confidence(F.col("question"), F.lit(""), none, F.col("answer")), 6).alias("confidence"))


def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.exchanges(spark, sf_dir)
    return rows.select("conv_id", "turn", answers.best_sentences(F.col("answer"), F.col("question")).alias("extract"))


def _part_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.table(spark, sf_dir, "part")
    asked = (
        F.when(F.col("p_partkey") % 5 == 0, F.lit("Give me a summary")).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("What is the price of "), "p_name", F.lit("?")))
        .when(F.col("p_partkey") % 5 == 2, F.lit("List all prices ")).when(F.col("p_partkey") % 5 == 3, F.lit("figure revenue shows model now")).otherwise(F.lit("any insights on the stock"))
    )
    return p.select(F.col("p_partkey").alias("qid"), F.col("p_partkey").alias("doc_id"), asked.alias("question"))


def _part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_numbers.key_numbers(corpus.figure_lines(spark, sf_dir)).withColumn("section", F.lit("§1"))


def key_number_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.match_key_numbers(_part_questions(spark, sf_dir), _part_numbers(spark, sf_dir)).select("qid", "label", "value", "unit")


def _part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.table(spark, sf_dir, "part")
    few = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_brand"), F.col("p_type"))).otherwise(F.array().cast("array<string>"))
    return p.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") > 25, F.concat(F.lit("About "), "p_name")).alias("summary"), few.alias("insights"))


def _part_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.figure_lines(spark, sf_dir).select(F.col("doc_id").alias("d_"), "text")
    none = F.array().cast("array<string>")
    rows = _part_questions(spark, sf_dir).join(lines.hint("merge"), F.expr("doc_id = d_"))
    tables = F.array().cast("array<struct<table_id:string,caption:string,headers:array<string>,rows:array<array<string>>>>")
    return rows.select("qid", "question", F.lit(0).alias("rank"), F.lit("§1").alias("id"), F.lit("").alias("title"), "text", F.lit(None).cast("string").alias("summary"), tables.alias("tables"), answers.confidence(F.col("question"), F.lit(""), none, F.col("text")).alias("confidence"))


def layer_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answers.answer(_part_questions(spark, sf_dir), _part_documents(spark, sf_dir), _part_numbers(spark, sf_dir), _part_hits(spark, sf_dir))
    return out.select("qid", "answer", F.array_join("citations", " ").alias("citations"), "layer_used", F.round("confidence", 6).alias("confidence"))


def layered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a stand-in model, which refuses one prompt in three; every other document has a second section."""

    def complete(prompt: str) -> str:
        return "I'm sorry, that is not found here." if len(prompt) % 3 == 0 else prompt[-40:]

    hits = _part_hits(spark, sf_dir)
    brand = corpus.table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("d_"), "p_brand")
    second = hits.join(brand.hint("merge"), F.expr("qid = d_")).withColumn("rank", F.lit(1)).withColumn("id", F.lit("§2")).withColumn("title", F.lit("More")).withColumn("text", F.concat(F.lit("of "), "p_brand")).drop("d_", "p_brand")
    out = answers.answer(_part_questions(spark, sf_dir), _part_documents(spark, sf_dir), _part_numbers(spark, sf_dir), hits.unionByName(second), complete)
    return out.select("qid", "answer", F.array_join("citations", " ").alias("citations"), "layer_used", "tokens_used", F.round("confidence", 6).alias("confidence"))


def answer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.exchanges(spark, sf_dir)
    odd = F.concat(F.when(F.col("turn") % 4 == 0, F.lit("List all ")).otherwise(F.lit("")), "question")
    reply = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("I'm sorry: "), "answer")).when(F.col("conv_id") % 3 == 1, F.lit("  ")).otherwise(F.col("answer"))
    return rows.select("conv_id", "turn", answers.is_complex(odd).alias("complex"), answers.is_refusal(reply).alias("refusal"), (answers.enumeration_hint(odd) != "").alias("enumeration"))


def quantize_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus.table(spark, sf_dir, "embeddings").select("vec_id", vectors.int8(F.col("embedding")).alias("q"))
    return v.select("vec_id", F.array_join("q", " ").alias("codes"), (F.round(F.aggregate(vectors.from_int8(F.col("q")), F.lit(0.0), lambda a, x: a + x.cast("double")), 6) + 0.0).alias("sum_back"))


def quantize_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over 61 components, so that the last byte is filled up."""
    v = corpus.table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.lower(vectors.binary_bits(F.slice("embedding", 1, 61))).alias("bits"), vectors.stride(F.lit(61), "binary").alias("stride"))


def quantize_float16(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus.table(spark, sf_dir, "embeddings").select("vec_id", vectors.quantizer("float16")("embedding").alias("b"))
    total = F.aggregate(vectors.dequantizer("float16", 64)("b"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select("vec_id", F.hex("b").alias("bytes"), (F.round(total, 6) + 0.0).alias("sum_back"))


def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus.table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalized(F.col("embedding")).alias("n"))
    return v.select("vec_id", F.round(vectors.dot(F.col("n"), F.col("n")), 5).alias("norm"), F.round(F.get("n", F.lit(0)).cast("double"), 5).alias("first"))


def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.fingerprints(tree.build_tree(corpus.sections(spark, sf_dir))).select("doc_id", "n_sections", "fingerprint")


def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a registry in which documents with an even number of sections are current and every third is missing."""
    now = doc_fingerprint(spark, sf_dir)
    registry = now.filter("doc_id % 3 <> 0").withColumn("fingerprint", F.when(F.col("n_sections") % 2 == 0, F.col("fingerprint")).otherwise(F.lit("old")))
    return index.stale(now, registry).select("doc_id", "n_sections")


def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.table(spark, sf_dir, "pages").select("page_id", "html")

    def run(batches):
        import pandas as pd

        for pdf_ in batches:
            rows = [(i, n, s["title"], s["level"], s["text"]) for i, page in zip(pdf_["page_id"], pdf_["html"]) for n, s in enumerate(html.sections(html.tree(page or "")))]
            yield pd.DataFrame(rows, columns=["page_id", "sec_idx", "title", "level", "text"])

    return pages.mapInPandas(run, "page_id bigint, sec_idx int, title string, level int, text string")


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines in turn are headings, fences and text."""
    line = lambda s, i: F.when(i % 5 == 1, F.concat(F.repeat(F.lit("#"), (i % 3 + 1)), F.lit(" "), s)).when(i % 7 == 3, F.lit("```")).otherwise(s)
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("fallback"), F.concat(F.lit("Before "), F.col("doc_id").cast("string")).alias("preamble"))
    return markdown.sections(docs).select("doc_id", "sec_idx", "title", "level", "text")


def pdf_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as page lines whose sizes follow from their lengths."""
    rows = corpus.sections(spark, sf_dir)
    size = F.when(F.col("sec_idx") % 6 == 0, 16.0).when(F.col("sec_idx") % 6 == 3, 13.0).when(F.length("text") % 7 == 0, 11.8).otherwise(11.0)
    return pdf.sections(rows.select("doc_id", F.col("sec_idx").alias("line_idx"), "text", size.alias("size"), (F.length("text") % 2 == 0).alias("bold")))


def phase_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    scores = corpus.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_").join(d, F.expr("l_ = doc_id")).select(F.col("lang").alias("phase"), F.col("source").alias("file"), (F.col("quality") * 7 + F.col("toxic") * 2).alias("score"))
    return judge.report(scores).select("phase", "file", "n", F.round("avg_score", 6).alias("avg_score"), F.round("hit_rate", 6).alias("hit_rate"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.exchanges(spark, sf_dir)
    numbers = lambda plus: F.concat(F.lit(" count: "), (F.col("conv_id") * 100 + F.col("turn") * plus).cast("string"), F.lit("; 1 234 items = 57"))
    return rows.select("conv_id", "turn", F.when(F.col("turn") % 4 == 2, F.lit("Not found in the context")).otherwise(F.concat("answer", numbers(3))).alias("candidate"), F.concat(F.when(F.col("conv_id") % 2 == 0, F.col("answer")).otherwise(F.col("question")), numbers(5)).alias("reference"))


def local_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge.local_scores(_judged(spark, sf_dir))
    return out.select("conv_id", "turn", F.round("num_ratio", 6).alias("num_ratio"), F.round("kw_ratio", 6).alias("kw_ratio"), F.round("phrase_ratio", 6).alias("phrase_ratio"), "score")


def model_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a stand-in judge, which grades by the length of what it is asked."""
    rows = _judged(spark, sf_dir).withColumn("question", F.concat(F.lit("turn "), F.col("turn").cast("string")))
    out = judge.model_scores(rows, lambda prompt: f"so:\nSCORE: {len(prompt) % 11}\nREASONING: length {len(prompt)}")
    return out.select("conv_id", "turn", "score", "reason")


def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("thinking\nScore: "), (F.col("quality") * 8 + F.col("toxic")).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit("/10")).otherwise(F.lit("")), F.lit("\r\nreasoning: because: yes"))
    v = judge.parse_verdict(F.when(F.col("doc_id") % 5 == 0, F.lit("no verdict")).otherwise(reply))
    return corpus.table(spark, sf_dir, "labels").select("doc_id", v["score"].alias("score"), v["reason"].alias("reason"))


#: A vocabulary for the WordPiece query.
PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz.,!?", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "the", "and", "##ing", "##tion", "that", "##er", "##ly"]


def wordpiece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = wordpiece.encode_udf(PIECES, 256)(F.col("text"))
    return corpus.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(ids, " ").alias("ids"))


def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all documents, written to archives and read back."""
    raw = corpus.sections(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string"))
    done, numbers = pipeline.process(raw)
    none = F.array().cast
    done = done.select("doc_id", "sec_idx", "id", "title", "level", "text", none("array<struct<table_id:string,caption:string,headers:array<string>,rows:array<array<string>>>>").alias("tables"), none("array<struct<image_id:string,alt:string,asset_path:string>>").alias("images"), "parent_id", "children", F.lit(None).cast("string").alias("summary"), "keywords", "token_count")
    docs = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "source", F.lit("txt").alias("format"), F.lit(None).cast("string").alias("summary"), none("array<string>").alias("insights"), F.lit(None).cast("struct<owner:string,department:string,tags:array<string>,access_roles:array<string>,version:string,last_updated:string>").alias("meta"), F.lit("2024-01-01T00:00:00.0000000+00:00").alias("created_at"))
    packed = archive.pack(archive.parts(docs, done, numbers))
    back = archive.sections_of(archive.unpack(packed.select(F.col("doc_id").alias("path"), F.col("archive").alias("content"))))
    return back.select("doc_id", "sec_idx", "id", "title", "level", "text", "parent_id", F.array_join("children", " ").alias("children"), F.array_join("keywords", " ").alias("keywords"), "token_count")


def archive_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label a document whose sections' vectors go into its archive as bytes, one after the other, and come back."""
    v = corpus.vectors(spark, sf_dir)
    kind = F.col("doc_id").cast("string").alias("doc_id")
    none = F.array().cast
    bytes_ = v.select(kind, "sec_idx", vectors.quantizer("int8")("vec").alias("bytes"), F.lit("own").alias("model"), F.size("vec").alias("dims"), F.lit("int8").alias("quantization"))
    rows = v.select(kind, "sec_idx", F.concat(F.lit("§"), (F.col("sec_idx") + 1).cast("string")).alias("id"), F.lit("t").alias("title"), F.lit(1).alias("level"), F.lit("").alias("text"), none("array<struct<table_id:string,caption:string,headers:array<string>,rows:array<array<string>>>>").alias("tables"), none("array<struct<image_id:string,alt:string,asset_path:string>>").alias("images"), F.lit(None).cast("string").alias("parent_id"), none("array<string>").alias("children"), F.lit(None).cast("string").alias("summary"), none("array<string>").alias("keywords"), F.lit(0).alias("token_count"))
    docs = v.select(kind).distinct().select("doc_id", F.lit("Label").alias("title"), F.lit("x").alias("source"), F.lit("txt").alias("format"), F.lit(None).cast("string").alias("summary"), none("array<string>").alias("insights"), F.lit(None).cast("struct<owner:string,department:string,tags:array<string>,access_roles:array<string>,version:string,last_updated:string>").alias("meta"), F.lit("2024-01-01").alias("created_at"))
    numbers = spark.createDataFrame([], "doc_id string, kn_idx int, label string, value string, unit string, section string")
    packed = archive.pack(archive.parts(docs, rows, numbers, embeddings=bytes_))
    back = archive.unpack(packed.select(F.col("doc_id").alias("path"), F.col("archive").alias("content")))
    return back.select("path", F.length("embeddings").cast("bigint").alias("n_bytes"), F.md5(F.hex("embeddings").cast("binary")).alias("md5"), F.col("manifest.embedding_dims").alias("dims"), F.col("manifest.quantization").alias("quantization"), F.col("manifest.section_count").alias("n_sections"))


def archive_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line shows of archives of all parts."""
    none = F.array().cast
    p = corpus.table(spark, sf_dir, "part")
    docs = p.select(F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_name").alias("title"), F.concat(F.lit("/in/"), "p_brand").alias("source"), F.lit("txt").alias("format"), F.when(F.col("p_size") > 25, F.concat(F.lit("About "), "p_name")).alias("summary"), none("array<string>").alias("insights"), F.lit(None).cast("struct<owner:string,department:string,tags:array<string>,access_roles:array<string>,version:string,last_updated:string>").alias("meta"), F.lit("2024-01-01").alias("created_at"))
    rows, numbers = pipeline.process(corpus.figure_lines(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("title", F.lit("Figures")).withColumn("level", F.lit(1)))
    rows = rows.select("doc_id", "sec_idx", "id", "title", "level", "text", none("array<struct<table_id:string,caption:string,headers:array<string>,rows:array<array<string>>>>").alias("tables"), none("array<struct<image_id:string,alt:string,asset_path:string>>").alias("images"), "parent_id", "children", F.lit(None).cast("string").alias("summary"), "keywords", "token_count")
    packed = archive.pack(archive.parts(docs, rows, numbers))
    return archive.info(archive.unpack(packed.select(F.col("doc_id").alias("path"), F.col("archive").alias("content"))))


QUERIES = {
    f.__name__: f
    for f in (
        section_tree, section_children, table_normalise, keywords_topk, figures, key_numbers_top, doc_slug, source_label, retrieval_tokens, postings_df, postings, bm25_topk, bm25_document, dense_topk,
        cosine_pairs, semantic_edges, structural_edges, rrf_fuse, graph_expand, hybrid_topk, porter_bm25, query_confidence, extractive_answer, key_number_match, layer_route, layered_answers, answer_flags,
        quantize_int8, quantize_binary, quantize_float16, normalized_vectors, doc_fingerprint, stale_documents, html_sections, markdown_sections, pdf_headings, phase_rollup, local_judge,
        verdict_parse, wordpiece_encode, archive_roundtrip, stored_index_topk, stored_index_stats, stemmed_hybrid, rerank_topk, embedded_sections, key_numbers_kept, model_judge, archive_vectors, archive_info,
    )
} | files.QUERIES
