"""Lines that answer questions, and the sources of answers, against plain versions."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators import answers
from tessera.plans import retrieval

SF = "/root/testdata/sf0.001"


def has(text, words):
    return any(w in text for w in words)


def types(q):
    q = (q or "").lower()
    t = {n: has(q, w) for n, w in V.QUESTION_TYPES.items()}
    t["setup"] = ("启动前" in q or "启动" in q and ("之前" in q or "先" in q)) and t["setup"]
    t["status"] = t["status"] or not t["listing"] and not t["fact"] and t["current"]
    return t


def key(line):
    at = line.find(" = ")
    return line[:at].strip(" ") if at > 0 else None


def fact(q, line):
    k = key(line)
    if k is not None:
        return has(k.lower(), V.KEY_PARTS)
    return types(q)["fact"] and has(line.lower(), V.KEY_PARTS) and bool(re.search(r"[0-9]", line))


def contents(line):
    return line == "目录" or line.lower().startswith("=== page:") or len(line) <= 120 and bool(re.fullmatch(r"(?s).*[？?].*\s+\d+|.*\t\d+", line))


def echo(s):
    return re.sub(r"[0-9]+$", "", re.sub(V.ECHO_SIGNS, "", (s or "").lower(), flags=re.A))


def echoes(q, line):
    a, b = echo(q), echo(line)
    return len(a) >= 6 and len(b) >= 6 and (b in a or a in b)


def score(q, raw, line, tokens):
    t, low, k = types(q), line.lower(), key(line)
    n = 10 * sum(x.lower() in low for x in tokens) + 6 * ("`" in line) + 12 * (" = " in line) + 10 * (k is not None and has(k.lower(), V.KEY_PARTS)) + 3 * bool(re.search("[0-9]", line))
    n += sum(w for words, w in V.LINE_WORDS if has(low, words)) - 2 * raw.lower().startswith(tuple(V.TEXT_FIELDS)) - max(0, (len(line) - 120) // 24)
    assigned = k is not None and bool(re.fullmatch(r"[A-Za-z0-9._-]+", k))
    lead = line.endswith((":", "：")) and "->" not in line and not re.search("[0-9]", line) and "`" not in line
    listed = bool(re.match(r"\||[-*•] |[0-9]+\.\s+", raw.strip(" "))) or assigned or line.count("；") >= 2 or line.count("、") >= 2 or "：" in line and not lead
    can = has(low, V.CAPABILITY_SIGNALS) or line.count("、") + line.count(" / ") + line.count("·") >= 2 or line.count("`") >= 4
    flows, heading = has(low, V.FLOW_SIGNALS), bool(re.match("#|<h[1-4]", raw.strip(" ").lower()))
    qlow = (q or "").lower()
    for cond, w in [
        (fact(q, line), 12), (echoes(q, line), -60), (contents(line), -80), (t["listing"] and listed, 32), (t["flow"] and has(low, V.STEP_SIGNS), 18), (assigned, 8),
        (t["number"] and re.search("[0-9]", line), 6), (t["current"] and has(low, V.CURRENT_SIGNS), 4), (t["setup"] and (re.match(r"[0-9]+\.\s+", line) or has(low, V.SETUP_SIGNS)), 24),
        (t["capability"] and can, 50), (t["flow"] and flows, 24), (t["status"] and has(low, V.STATUS_SIGNS), 24), (t["status"] and heading, -8), (t["flow"] and heading, -8), (t["listing"] and heading, -18),
        (t["flow"] and lead and not flows, -10), (t["listing"] and lead and not listed, -14), (t["capability"] and re.search(V.SUMMARY_SENTENCES, line), -18), (t["capability"] and assigned, -50), (t["setup"] and assigned, -28),
        ("配置" in qlow and (low.startswith("代码中的") or "数值一致" in low), -8),
    ]:
        n += w if cond else 0
    return n


def plain_answer(hits, limit):
    """hits of one question: (question, tokens, content, rank)."""
    q, tokens = hits[0][:2]
    t, found = types(q), {}
    for _, _, content, rank in sorted(hits, key=lambda h: h[3]):
        some = []
        for i, raw in enumerate(re.split("\r\n|\r|\n", content or "")):
            raw = raw.strip(" ")
            if raw and raw != "---" and not re.match(r"[#>]|!\[|\|[ :|-]+\|?$", raw) and not re.search(V.FIELD_LINES, raw.lower()) and not contents(raw):
                some.append((raw, (rank, i)))
        if not any(t[k] for k in ("fact", "status", "capability", "flow", "listing")):
            some = [x for x in some if has(x[0].lower(), [w.lower() for w in tokens])][:6]
        for raw, place in some:
            line = re.sub("^- ", "", raw).strip(" ")
            if line:
                s = score(q, raw, line, tokens)
                old = found.get(line, (s, place))
                found[line] = (max(s, old[0]), min(place, old[1]))
    rows = [(line, s, p) for line, (s, p) in found.items() if not echoes(q, line)]
    facts, states = [r for r in rows if fact(q, r[0])], [r for r in rows if t["status"] and has(r[0].lower(), V.STATUS_SIGNS)]
    rows = states if t["status"] and states else rows if t["listing"] and not t["fact"] else facts or rows
    rows = [(r[0], r[1]) for r in sorted(rows, key=lambda r: (-r[1], len(r[0]), r[2], r[0]))]
    picked = []
    if limit > 1 and t["fact"]:
        for part in parts(q):
            for line, s in rows:
                if len(picked) < limit and part in line.lower() and line not in [p[0] for p in picked]:
                    picked.append((line, s, part))
                    break
    picked += [(line, s, None) for line, s in rows if line not in [p[0] for p in picked]]
    return [(i + 1, *p) for i, p in enumerate(picked[:limit])]


def parts(q):
    out = []
    for s in re.split(V.FOCUS_SEPARATORS, q):
        s = s.lower()
        for w in V.FOCUS_FILLERS:
            s = s.replace(w, " ")
        s = re.sub(r"\s+", " ", re.sub(V.FOCUS_SIGNS, " ", s)).strip(" ")
        if s and (has(s, V.KEY_PARTS) or len(s) >= 2):
            out.append(s)
    return out


def compare(hits, limit):
    by = {}
    for r in hits.collect():
        by.setdefault(r.question_id, []).append((r.question, r.tokens, r.content, r["rank"]))
    wanted = {(q, *row) for q, rows in by.items() for row in plain_answer(rows, limit)}
    found = {tuple(r) for r in answers.focused_answer(hits, limit).select("question_id", "place", "line", "score", "part").collect()}
    assert found == wanted
    return found


def test_all_questions_equal_a_plain_greedy(spark):
    hits = retrieval.asked_hits(spark, SF).cache()
    assert compare(hits, 3)


HITS = "question_id long, question string, tokens array<string>, content string, rank long"
PAGE = """# Retry
title: nothing
- retry.max = 5
- retry.timeout = 30s
* `retry.window` is 60
pool_size = 8
当前可用：是
未配置 mail
流程：a -> b -> c
入口有 api、cli、mcp
1. 创建 schema
What is it?   12
--- 
> quoted
the pool is 汇总 of 3
the pool is 汇总 of 3
"""


@pytest.mark.parametrize("limit", [1, 3])
def test_question_types(spark, limit):
    asked = ["retry.max 和 timeout 分别多少？", "pool 的当前状态", "支持哪些入口", "流程是什么", "启动前需要准备什么配置", "pool", "", None, "retry、retry、pool 的值", "the pool is 汇总 of"]
    rows = [(i, q, ["pool", "retry"], page, r) for i, q in enumerate(asked) for r, page in enumerate([PAGE, PAGE.replace("5", "6"), None, ""])]
    found = compare(spark.createDataFrame([r for r in rows if r[1] is not None], HITS), limit)
    if limit == 3:
        first = {r[4]: r[2] for r in found if r[0] == 0 and r[4]}
        assert first["retry.max"].startswith("retry.max = ") and first["timeout"] == "retry.timeout = 30s"
    assert answers.focused_answer(spark.createDataFrame([], HITS), limit).count() == 0


def test_sources_prefer_active_projections_and_high_priorities(spark):
    hits = spark.createDataFrame(
        [(1, "SOURCE", "k1", "", "t", "a#x", 1), (1, "ARTICLE", "k2", "c", "t", "b", 2), (2, "GRAPH", "k1", "", "", "", 3), (2, "SOURCE", "k2", "", "", "p#1", 1), (2, "ARTICLE", "k2", "c", "t", "q", 5), (2, "CONTRIBUTION", "k3", None, None, None, 2), (2, "SOURCE", "k4", "", "", "q#9", 4)],
        "question_id long, evidence_type string, key string, concept_id string, title string, path string, rank long",
    )
    projections = spark.createDataFrame([(1, "k9", "ACTIVE", 2), (1, "k8", "ACTIVE", 1), (1, "k8", "ACTIVE", 3), (2, "k7", "REMOVED", 1)], "question_id long, key string, status string, ordinal int")
    found = {(r.question_id, r.place): (r.key, r.origin) for r in answers.response_sources(hits, projections).collect()}
    assert found == {(1, 1): ("k8", "PROJECTION"), (1, 2): ("k9", "PROJECTION"), (2, 1): ("k2", "HIT"), (2, 2): ("k1", "HIT"), (2, 3): ("k3", "HIT")}
    assert answers.response_sources(hits, projections.where(F.lit(False))).where("question_id = 1").count() == 2
