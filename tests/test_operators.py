"""Literal cases and invariants of the core's operators."""

import io
import re
import zipfile

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import compile as C
from tessera.operators import evidence as E
from tessera.operators import governance as G
from tessera.operators import graph
from tessera.operators import retrieval as R
from tessera.operators import versioning as X
from tessera.plans import governance
from tessera.sources import files, java
from tessera.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    found = one(spark, T.tokens(F.lit("用户确认的运维口径说重试间隔是什么")))
    assert {"重试", "间隔"} <= set(found) and not any("的" in t for t in found)
    found = one(spark, T.tokens(F.lit("RoutePlanner 在 src/main/java/payment/RoutePlanner.java 里怎么读取 payment.retry.maxAttempts")))
    assert {"routeplanner", "route", "planner", "src/main/java/payment/routeplanner.java", "payment.retry.maxattempts"} <= set(found)
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []
    assert "http" in one(spark, T.tokens(F.lit("HTTPServer")))


def test_high_signal_and_intent(spark):
    assert one(spark, T.high_signal(F.lit("payment.retry.maxAttempts 是什么"))) == ["payment.retry.maxattempts", "payment", "retry", "maxattempts"]
    assert one(spark, T.high_signal(F.lit("a"))) == []
    for question, intent in [("为什么支付超时要做重试编排的架构", "ARCHITECTURE"), ("RoutePlanner.java", "CODE_STRUCTURE"), ("payment.retry.maxAttempts 是什么配置", "CONFIGURATION"), ("为什么不生效", "TROUBLESHOOTING"), ("重试间隔一般多久", "GENERAL")]:
        assert one(spark, T.intent(F.lit(question))) == intent


def test_questions(spark):
    assert one(spark, T.is_deep(F.lit("成本、延迟、风险的区别"))) and one(spark, T.is_deep(F.lit("为什么失败"))) and not one(spark, T.is_deep(F.lit("区别")))
    assert one(spark, T.split_question(F.lit("甲和乙有什么区别？"))) == ["甲 的关键结论是什么", "乙 的关键结论是什么"]
    assert one(spark, T.split_question(F.lit("plain"))) == []
    assert one(spark, T.config_candidates(F.lit("max attempts")))[:3] == ["max.attempts", "max_attempts", "max-attempts"]


def test_fusion(spark):
    hits = spark.createDataFrame([(1, "fts", "ARTICLE", "article-a", 1), (1, "fts", "ARTICLE", "article-b", 2), (1, "chunk_vector", "ARTICLE", "article-b", 1)], "question_id long, channel string, evidence_type string, key string, rank int")
    weights = spark.createDataFrame([(1, "fts", 1.0), (1, "chunk_vector", 8.0)], "question_id long, channel string, weight double")
    found = R.fuse(hits, weights, k=1).orderBy("rank").collect()
    assert [r.key for r in found] == ["article-b", "article-a"]
    assert abs(found[0].score - (1 / 3 + 8 / 2)) < 1e-9 and abs(found[1].score - 0.5) < 1e-9


def test_best_chunk(spark):
    hits = spark.createDataFrame([(1, "a", "low", 0.61, 2), (1, "a", "high", 0.93, 1), (1, "b", "x", 0.7, 3)], "question_id long, key string, chunk string, score double, rank int")
    assert [(r.chunk, r.rank) for r in R.best_chunk(hits).orderBy("rank").collect()] == [("high", 1), ("x", 2)]


def test_relevance_falls_back(spark):
    hits = spark.createDataFrame([(1, "x", False), (1, "y", False), (2, "z", True), (2, "w", False)], "question_id long, key string, relevant boolean")
    assert {r.key for r in R.keep_relevant(hits).collect()} == {"x", "y", "z"}


def test_rerank_prefers_config_file(spark):
    rows = spark.createDataFrame([("img", ["a/pic.png"], 24.0), ("yaml", ["conf/app.yaml"], 8.0)], "key string, paths array<string>, score double")
    bonus = R.intent_bonus(F.lit("payment retry maxAttempts config"), F.lit("CONFIGURATION"), F.col("key"), F.lit(""), F.lit(""), F.lit(""), F.col("paths"))
    assert rows.withColumn("s", F.col("score") + bonus).orderBy(F.desc("s")).first().key == "yaml"


def test_chunks():
    text = "# Payment Timeout\nintro line\n\n## Timeout Rules\nrule one here\n\n## Fallback\nretry later\n"
    found = C.chunks(text, 45, 0.15)
    assert len(found) > 1 and "# Payment Timeout" in found[0][0]
    assert any("## Timeout Rules" in c for c, _ in found) and any("## Fallback" in c for c, _ in found)
    fence = "before\n\n```java\n" + "int x = 1;\n" * 8 + "```\nafter"
    holding = [c for c, _ in C.chunks(fence, 40, 0.15) if "int x" in c]
    assert len(holding) == 1 and holding[0].count("```") == 2
    assert C.chunks("", 10) == [] and C.chunks(" \n\n", 10) == []
    starts = [at for _, at in C.chunks("line\n\n" * 200, 60)]
    assert starts == sorted(set(starts))


def test_batches_rank_and_groups(spark):
    rows = spark.createDataFrame([(1, "a.txt", "xxxxx"), (1, "b.txt", "xxxx"), (1, "c.txt", "xxxxx")], "source_id long, path string, content string")
    assert [r.batch for r in C.batches(rows, 10).orderBy("path").collect()] == [0, 0, 1]
    names = spark.createDataFrame([(1, n, c) for n, c in [("huge-spec.md", "x" * 120_000), ("architecture.md", ""), ("README.md", ""), ("CLAUDE.md", ""), ("overview.md", "")]], "source_id long, path string, content string")
    order = [r.path for r in C.ranked_files(names).orderBy("place").collect()]
    assert order[0] == "overview.md" and order[-1] == "huge-spec.md"
    paths = spark.createDataFrame([("docs/guide.md", ""), ("payment/App.java", ""), ("README.md", "")], "path string, content string")
    assert {r["group"] for r in C.groups(paths, [("^docs/.*", "knowledge-docs")]).collect()} == {"knowledge-docs", "payment", "README"}


def test_merge_concepts(spark):
    rows = spark.createDataFrame([(0, "payment-service", "Payment", "short", ["a"], ["s"]), (1, "payment_service", "Payment Service", "a longer one", ["b", "a"], ["s"])], "position long, concept_id string, title string, description string, paths array<string>, snippets array<string>")
    [r] = C.merge_concepts(rows).collect()
    assert (r.slug, r.title, r.description, r.paths, r.snippets) == ("payment-service", "Payment Service", "a longer one", ["a", "b"], ["s"])


def test_coverage(spark):
    known = spark.createDataFrame([(f"payment/{x}.md",) for x in "abcd"], "path string")
    articles = spark.createDataFrame([(["payment/a.md", "payment/b.md#Timeout Rules"],), (["payment/c.md", "payment/b.md", "payment/missing.md"],)], "source_paths array<string>")
    assert G.coverage(known, articles).first().asDict() == {"total": 4, "covered": 3, "ratio": 0.75}
    assert [r.path for r in G.omitted_paths(known, articles).collect()] == ["payment/d.md"]


def test_edges_and_impact(spark):
    rows = [("payment-timeout", ["payment-config"], ["retry-policy"], "x [[gateway-timeout]]"), ("refund-manual-review", [], [], "[[payment-timeout|text]]"), ("payment-config", [], [], ""), ("retry-policy", [], [], ""), ("gateway-timeout", [], [], "")]
    articles = spark.createDataFrame([(i, None, c, c, d, r, t) for i, (c, d, r, t) in enumerate(rows)], "ordinal long, source_id long, article_key string, concept_id string, depends_on array<string>, related array<string>, content string")
    links = graph.edges(articles)
    assert links.count() == 5
    reached = {r.node: r.depth for r in graph.impact(links, spark.createDataFrame([("payment-config",)], "root string")).collect()}
    assert reached == {"payment-timeout": 1, "retry-policy": 2, "refund-manual-review": 2}


def test_impact_has_no_depth_limit(spark):
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(22)] + [("n19", "n05"), ("n03", "m1"), ("m1", "n02"), ("x1", "n12")]
    links = spark.createDataFrame([(a, b, "depends_on") for a, b in pairs], "upstream string, downstream string, relation string")
    wanted = set()
    for root in {a for a, _ in pairs}:
        depth, queue = {root: 0}, [root]
        for node in queue:
            for a, b in pairs:
                if a == node and b not in depth:
                    depth[b] = depth[node] + 1
                    queue.append(b)
        wanted |= {(root, node, d) for node, d in depth.items() if d}
    found = graph.impact(links, links.selectExpr("upstream AS root")).collect()
    assert max(d for _, _, d in wanted) > 20 and {tuple(r)[:3] for r in found} == wanted and len(found) == len(wanted)
    article = spark.createDataFrame([("n00", ["p"])], "concept_id string, paths array<string>")
    kinds = {r.concept_id: r.kind for r in C.incremental_plan(article, article, links).collect()}
    assert kinds == {"n00": "enhance"} | {node: "propagate" for root, node, _ in wanted if root == "n00"}


def test_impact_all_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    down = {}
    for r in governance.edges(spark, sf).collect():
        down.setdefault(r.upstream, set()).add(r.downstream)
    wanted = set()
    for root in down:
        depth, queue = {root: 0}, [root]
        for node in queue:
            for b in down.get(node, ()):
                if b not in depth:
                    depth[b] = depth[node] + 1
                    queue.append(b)
        wanted |= {(root, node, d) for node, d in depth.items() if d}
    found = governance.impact_all(spark, sf).collect()
    assert {tuple(r)[:3] for r in found} == wanted and len(found) == len(wanted) and all(r.relation for r in found)


def test_ledger(spark):
    rows = spark.createDataFrame([(0, "k", "s", "5", "times", "c", 0.8, ["ev#1"]), (1, "k", "s", "5", "times", "c", 0.9, ["ev#2", "ev#1"]), (2, "k", "s", "3", "times", "d", 0.7, ["ev#3"]), (3, "z", "s", "1", "", "e", 0.54, ["ev#4"])], "position long, fact_key string, subject string, value_text string, unit string, claim string, confidence double, anchors array<string>")
    merged = E.merge_findings(rows)
    best = merged.where("value_text = '5'").first()
    assert best.anchors == ["ev#1", "ev#2"] and best.confidence == 0.9 and merged.count() == 2
    assert E.conflicts(merged).first().variants == ["3|times", "5|times"]


def test_claims():
    report = "# 问题\n\n什么\n\n## 结论\n\n- 第一条 [[a]]\n- 第二条 [[b]]\n\n## 分层摘要\n\n摘要\n\n## 冲突提示\n\n无"
    assert E.claims_of(report) == ["第一条 [[a]]", "第二条 [[b]]"]
    assert len(E.claims_of("一。二；三 [[k]]")) == 3 and all("[[k]]" in c for c in E.claims_of("一。二；三 [[k]]"))
    assert E.claims_of("") == [] and E.claims_of("```\ncode\n```") == []


def test_citation_scenarios(spark):
    rows = [("业务码 12101 会写入 fulfillment_request [[dispatch-table]]", "VERIFIED"), ("业务码 12103 会写入 fulfillment_request [[dispatch-table]]", "DEMOTED"), ("RoutePlanner 暴露了 /payments 路径 [→ src/main/java/payment/RoutePlanner.java]", "VERIFIED"), ("这是一个一般性的系统描述 [[payment-routing]]", "SKIPPED"), ("code 7 [[unknown]]", "NOT_FOUND")]
    claims = spark.createDataFrame([(i, 0, c) for i, (c, _) in enumerate(rows)], "answer_id long, claim_index int, claim string")
    evidence = spark.createDataFrame([("ARTICLE", "dispatch-table", "12101 => fulfillment_request"), ("SOURCE_FILE", "src/main/java/payment/RoutePlanner.java", "class RoutePlanner { String p = \"/payments\"; }"), ("ARTICLE", "payment-routing", "text")], "kind string, target string, text string")
    cited = E.ordinals(claims).join(claims, ["answer_id", "claim_index"])
    found = {r.answer_id: r.status for r in E.validate(cited, evidence).collect()}
    assert [found[i] for i in range(len(rows))] == [s for _, s in rows]


def test_upsert_takes_null_keys(spark):
    base = spark.createDataFrame([(None, "p", "old"), (1, "p", "keep")], "source_id long, path string, v string")
    delta = spark.createDataFrame([(None, "p", "new")], "source_id long, path string, v string")
    assert {(r.source_id, r.v) for r in X.upsert(base, delta, ["source_id", "path"]).collect()} == {(None, "new"), (1, "keep")}


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = {"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"}


def test_extractors():
    assert files.docx_text(zipped(DOCX)) == "Hello\n=== Table: 1 ===\na | b"
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>'
    assert files.pptx_text(zipped({"ppt/slides/slide2.xml": slide.format("two"), "ppt/slides/slide1.xml": slide.format(" ")})) == "=== Slide: 2 ===\ntwo"
    book = {"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>n</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c/></row></sheetData></worksheet>'}
    assert files.xlsx_text(zipped(book)) == "=== Sheet: S ===\nn,5"
    assert files.pages_text(["a", " ", "b"]) == "=== Page: 1 ===\na\n\n=== Page: 3 ===\nb" and files.pages_text([" "]) is None


def test_scan_and_extract(spark, tmp_path):
    for name, data in {"a.md": b"text", "node_modules/x.js": b"no", "pic.png": b"\x89", "d/doc.docx": zipped(DOCX), "bad.docx": b"no", "._b.md": b"no", "c.exe": b"no", "p.pdf": b"%PDF"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = {r.path: (r.text, r.mode) for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert found == {"a.md": ("text", "TEXT"), "pic.png": ("[Image file: pic.png]", "IMAGE"), "d/doc.docx": ("Hello\n=== Table: 1 ===\na | b", "NATIVE"), "bad.docx": (None, "FAILED"), "p.pdf": (None, "UNSUPPORTED")}


def test_java():
    source = 'package payment;\n@RequestMapping("/pay")\npublic class RoutePlanner extends Base implements Plan {\n  private PaymentService service;\n  @GetMapping("/x")\n  public String plan(int a) { return service.plan(a) + util.run(); }\n}\n'
    rows = java.parse("R.java", source)
    facts = {(r[0], r[2], r[3], r[4], r[5]) for r in rows}
    assert ("fact", "payment.RoutePlanner", "annotation", "@RequestMapping", 0.9) in facts and ("fact", "payment.RoutePlanner", "http_mapping", "/pay", 0.95) in facts
    assert ("relation", "payment.RoutePlanner.plan", "calls", "PaymentService.plan", 0.8) in facts and ("relation", "payment.RoutePlanner.plan", "calls", "util.run", 0.5) in facts
    assert ("relation", "payment.RoutePlanner", "extends", "Base", 0.9) in facts and ("relation", "payment.RoutePlanner", "declares_method", "payment.RoutePlanner.plan", 1.0) in facts


def test_stream(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (1L, 'a\n\nb', timestamp'2024-01-01 00:00:00'), (2L, 'a\n\nb', timestamp'2024-01-01 00:01:00'), (3L, 'c', timestamp'2024-01-01 00:02:00') AS t(id, text, arrived_at)").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = ingest.fresh(ingest.arriving(spark, str(tmp_path / "in"), "id long, text string, arrived_at timestamp"))
    ingest.chunk_into(rows, "id", "text", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.chunk for r in found) == ["a\n\nb", "c"]


SF = "/root/testdata/sf0.001"


def test_knowledge_search(spark):
    """Fusion, ranks and audit of the nine channels, worked out again from the audit's rows."""
    from tessera.plans import retrieval

    questions = retrieval.view(spark, SF, "questions")
    asked = R.rewrite(questions, retrieval.RULES).select("question_id", F.col("rewritten").alias("question"))
    weights = {(r.question_id, r.channel): r.weight for r in R.channel_weights(asked).collect()}
    best, audit = (df.collect() for df in retrieval.searched(spark, SF))
    assert {r.channel for r in audit} >= {"article_chunk_fts", "refkey", "source", "source_chunk_fts", "contribution", "graph", "article_vector", "chunk_vector"}
    scores = {}
    for r in audit:
        assert r["rank"] <= 5 and weights[r.question_id, r.channel] > 0
        at = (r.question_id, r.evidence_type, r.key)
        scores[at] = scores.get(at, 0.0) + weights[r.question_id, r.channel] / (60 + r["rank"])
    found = {}
    for r in best:
        assert abs(scores[r.question_id, r.evidence_type, r.key] - r.score) < 1e-8
        found.setdefault(r.question_id, []).append(r)
    for q, rows in found.items():
        best = sorted((-round(v, 12), k[2], k[1]) for k, v in scores.items() if k[0] == q)[:5]
        assert {(r.evidence_type, r.key) for r in rows} <= {(t, k) for _, k, t in best}
        assert all(r.relevant for r in rows) or not any(r.relevant for r in rows)


def test_lexical_takes_full_text_matches_too(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "alpha beta", "x"), (3, "alpha alpha beta gamma", "alpha"), (4, None, None)], "id long, text string, title string")
    q = spark.createDataFrame([(1, "a c"), (2, "beta alpha")], "question_id long, question string")
    found = {(r.question_id, r.id): round(r.score, 6) for r in R.lexical(q, docs, "id", {"text": 3.0, "title": 1.5}, 5, "text").collect()}
    assert found == {(1, 1): 0.05, (2, 2): 6.1, (2, 3): 7.6}  # one cover each, the first with a word between
    assert R.lexical(q, docs.limit(0), "id", {"text": 3.0}, 5, "text").count() == 0


def test_full_text_match_needs_all_terms(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five"), (3, "six six one two three four five")], "id long, text string")
    q = spark.createDataFrame([(1, "Six, five four three two one?"), (2, "seven one"), (3, "..")], "question_id long, question string")
    assert {(r.question_id, r.id, round(r.score, 6)) for r in R.fts_match(q, docs, "id", "text").collect()} == {(1, 1, 0.1), (1, 3, 0.1)}


def test_relevance_of_flows_capabilities_and_upkeep(spark):
    kind = "question_id long, question string, evidence_type string, key string, concept_id string, title string, description string, content string, paths array<string>"
    rows = [
        (1, "下单流程怎么走", "ARTICLE", "a", "", "t", "", "客户端 -> 网关", []), (1, "下单流程怎么走", "ARTICLE", "b", "", "t", "", "nothing", []),
        (2, "有哪些接入方式", "ARTICLE", "a", "", "t", "", "`x` `y`", []), (2, "有哪些接入方式", "ARTICLE", "b", "", "t", "", "none", []),
        (3, "trans-job 补偿任务怎么执行", "ARTICLE", "a", "", "trans-job", "", "x", []), (3, "trans-job 补偿任务怎么执行", "ARTICLE", "b", "", "怎么执行", "", "x", []),
    ]
    found = {(r.question_id, r.key): r.relevant for r in R.relevance(spark.createDataFrame(rows, kind)).collect()}
    assert found == {(1, "a"): True, (1, "b"): False, (2, "a"): True, (2, "b"): False, (3, "a"): True, (3, "b"): False}
    more = [(4, "RoutePlanner reads what", e, k, "", t, "", c, []) for e, k, t, c in (("ARTICLE", "a", "RoutePlanner", "x"), ("ARTICLE", "b", "other", "routeplanner route planner reads what"), ("GRAPH", "g", "zzz", "zzz"), ("ARTICLE", "d", "zzz", "zzz"))]
    assert {r.key for r in R.research_hits(R.relevance(spark.createDataFrame(more, kind))).collect()} == {"a", "g"}


def test_small_text_functions(spark):
    assert T.clamp(0, 5, 20) == 5 and T.clamp(50, 5, 20) == 20 and T.clamp(7, 5, 20) == 7
    assert one(spark, T.vector_literal(F.array(F.lit(1.5), F.lit(-2.0)))) == "[1.5,-2.0]" and one(spark, T.vector_of(F.lit("[1.5, -2]"))) == [1.5, -2.0] and one(spark, T.vector_of(F.lit("x"))) is None
    assert one(spark, T.unfenced(F.lit(" see ```json\n{}\n``` "))) == "{}" and one(spark, T.unfenced(F.lit("```json\n{}"))) == "```json\n{}" and one(spark, T.unfenced(F.lit(None).cast("string"))) == ""
    assert list(C.whole_objects('[{"a":"]}"},{"b":1},{"c', 1)) == ['{"a":"]}"}', '{"b":1}']


def test_citation_repair(spark):
    claims = spark.createDataFrame([(1, 0, "A 1 [[x]] [[y]]"), (1, 1, "B 2 [[z]]"), (1, 2, "C plain"), (2, 0, "D 4 [[w]]"), (2, 1, "E")], "answer_id long, claim_index int, claim string")
    checked = spark.createDataFrame([(1, 0, 0, "[[x]]", "VERIFIED"), (1, 0, 1, "[[y]]", "DEMOTED"), (1, 1, 2, "[[z]]", "DEMOTED"), (2, 0, 0, "[[w]]", "DEMOTED")], "answer_id long, claim_index int, ordinal int, literal string, status string")
    found = {(r.answer_id, r.claim_index): r.claim.strip() for r in E.repair_claims(claims, checked).collect()}
    assert found == {(1, 0): "A 1 [[x]]", (1, 1): "B 2 [[x]]", (1, 2): "C plain [[x]]", (2, 0): "D 4（当前证据不足）", (2, 1): "E（当前证据不足）"}


def test_multi_hop_and_graph_rates(spark):
    expected = spark.createDataFrame([(1, "Timeout is 3"), (1, "retry")], "question_id long, claim string")
    found = spark.createDataFrame([(1, "the timeout is 30 s")], "question_id long, claim string")
    assert E.multi_hop(expected, found).first().completeness == 0.5 and E.multi_hop(expected.limit(0), found).first().completeness is None
    assert E.graph_fact_rate(spark.createDataFrame([(True,), (False,)], "accepted boolean")).first().accepted_rate == 0.5


def test_evidence_that_repeats_a_target_counts_once(spark):
    cited = spark.createDataFrame([(1, 0, "code 12 [[a]]", "ARTICLE", "a")], "answer_id long, claim_index int, claim string, kind string, target string")
    evidence = spark.createDataFrame([("ARTICLE", "a", "code 12"), ("ARTICLE", "a", "nothing")], "kind string, target string, text string")
    assert [r.status for r in E.validate(cited, evidence).collect()] == ["VERIFIED"]


def test_channels_without_the_automaton(spark, monkeypatch):
    assert R.finder(["ab", "b"])("xabx") == {0, 1} and R.finder([])("x") == set()
    monkeypatch.setattr(R, "ahocorasick", None)
    assert R.finder(["ab", "b"])("xabx") == {0, 1}


def test_token_blocks_keep_questions_whole(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_TOKENS", 4)
    q = spark.createDataFrame([(i, f"alpha{i} beta gamma") for i in range(9)], "question_id long, question string")
    docs = spark.createDataFrame([(i, f"alpha{i} beta") for i in range(9)], "id long, text string")
    found = R.like_top(q, docs, "id", {"a": {"text": 1.0}, "b": {"text": 2.0}}, 1).collect()
    assert {(r.question_id, r.channel, r.id, r.score) for r in found} == {(i, c, i, 2.0 * w) for i in range(9) for c, w in (("a", 1), ("b", 2))}


def test_questions_split(spark):
    from tessera.plans import retrieval

    assert {(r.place, r.part[-9:]) for r in retrieval.question_split(spark, SF).collect()} <= {(k, " 的关键结论是什么") for k in range(3)}


def test_folder_scan(spark):
    import os

    from tessera.plans import compile as plans

    rows = plans.folder_scan(spark, SF).collect()
    assert [r.path.split("/")[0] for r in rows] == sorted(r.path.split("/")[0] for r in rows) and {r.extension for r in rows} == {"parquet"}
    flat = {f for f in os.listdir(SF) if os.path.isfile(f"{SF}/{f}")}
    assert flat <= {r.path for r in rows} and all(r.size == os.path.getsize(f"{SF}/{r.path}") for r in rows)


def test_text_search_config():
    assert R.text_search_config(["jiebacfg", "simple"]) == "jiebacfg" and R.text_search_config([]) == "simple"


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)] + [(None, "n")], "k long, v string").repartition(7)
    found = sorted((r.place, r.k) for r in R.numbered(rows, [F.asc_nulls_first("k")]).collect())
    assert found == [(1, None), *((k + 2, k) for k in range(1000))]


def test_entity_search_looks_for_tokens_and_not_for_questions(spark, monkeypatch):
    """Many questions of few texts: what is broadcast are the different tokens, and facts are asked for the entities found only."""
    rows = [(i, ("Blue", "red", "hot", None)[i % 4], f"{('Blue', 'red', 'hot', None)[i % 4] or 'no'} {('ring', 'bolt')[i % 3 % 2]}", i % 5 == 0) for i in range(300)]
    entities = spark.createDataFrame(rows, "entity_id long, simple_name string, canonical_name string, unresolved boolean")
    texts = ["blue bolt", "RING", "nothing here", "", None, "red ring hot"]
    asked = [(q, texts[q % len(texts)]) for q in range(600)]
    sent, wanted = [], []
    broadcast = R.spark_broadcast
    monkeypatch.setattr(R, "MOST_TOKENS", 4)
    monkeypatch.setattr(R, "spark_broadcast", lambda df, value: sent.append(value) or broadcast(df, value))

    def blocks(only):
        wanted.extend(r.entity_id for r in only.collect())
        return entities.join(only, "entity_id", "left_semi").select("entity_id", F.concat(F.lit("x "), "canonical_name", F.lit(" ring")).alias("block"))

    found = graph.entity_search(spark.createDataFrame(asked, "question_id long, question string"), entities, blocks, 3).collect()
    expected, held = set(), set()
    for q, text in asked:
        tokens = set(re.findall(r"[a-z0-9]{2,}", (text or "").lower()))
        meets = sorted((s or "", i) for i, s, c, _ in rows if any(t in (s or "").lower() or t in c.lower() for t in tokens))[:8]
        held |= {i for _, i in meets}
        scores = []
        for _, i in meets:
            _, s, c, unresolved = rows[i]
            score = sum(3.0 * (t in (s or "").lower()) + 2.5 * (t in c.lower()) + (t in f"x {c} ring".lower()) for t in tokens)
            scores.append((-round(score * (0.6 if unresolved else 1), 9), i))
        expected |= {(q, i, -s, n) for n, (s, i) in enumerate(sorted(scores)[:3], 1)}
    assert {(r.question_id, r.entity_id, r.score, r["rank"]) for r in found} == expected and expected
    assert sorted(t for block in sent for t in block) == ["blue", "bolt", "here", "hot", "nothing", "red", "ring"] and max(map(len, sent)) < 7
    assert set(wanted) == held and len(wanted) < 100


def test_full_text_matches_and_chunks_shuffle_no_text(spark):
    docs = spark.createDataFrame([(i, "a c " + "b " * (i % 3), f"t{i}") for i in range(50)] + [(99, None, "x")], "id long, text string, title string")
    q = spark.createDataFrame([(1, "c a"), (2, "B"), (3, "nowhere"), (4, None)], "question_id long, question string")
    found = R.fts_match(q, docs, "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = {(r.question_id, r.id): round(r.score, 9) for r in found.collect()}
    assert got == {(1, i): 0.1 for i in range(50)} | {(2, i): round(0.1 * (i % 3), 9) for i in range(50) if i % 3}
    cut = C.chunked(docs, "id", "text", keep=("title",))
    assert {(r.id, r.chunk_index, r.title) for r in cut.collect()} == {(i, 0, f"t{i}") for i in range(50)}
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()


def test_knowledge_search_sorts_the_facts_of_found_entities_only(spark, monkeypatch):
    from tessera.plans import retrieval

    seen, block = [], graph.facts_block
    monkeypatch.setattr(graph, "facts_block", lambda e, *lines: seen.append((e.count(), lines[0].select("entity_id").distinct().count())) or block(e, *lines))
    q = spark.createDataFrame([(1, "blue ring")], "question_id long, question string")
    hits = retrieval._channels(spark, SF, 5)["graph"](q).collect()
    assert len(hits) == 5 and all(r.content for r in hits)
    assert len(seen) == 2 and max(n for pair in seen for n in pair) <= 10 < spark.read.parquet(f"{SF}/part.parquet").count()
