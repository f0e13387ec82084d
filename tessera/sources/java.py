"""Entities, facts and relations of Java sources, by a light parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TYPE = re.compile(r"((?:@\w+(?:\([^)]*\))?\s*)*)(?:public\s+|protected\s+|private\s+|abstract\s+|final\s+|static\s+|sealed\s+)*\b(class|interface|enum|record)\s+(\w+)(?:<[^{]*?>)?([^{;]*)\{")
METHOD = re.compile(r"((?:@\w+(?:\([^)]*\))?\s*)*)(?:public|protected|private)\s+(?:static\s+|final\s+|abstract\s+|synchronized\s+)*(?:<[^>]+>\s*)?([\w<>\[\], .?]+?)\s+(\w+)\s*\(([^)]*)\)[^{;]*[{;]")
ANNOTATION = re.compile(r"@(\w+)(\([^)]*\))?")
MAPPING = re.compile(r"@(?:Request|Get|Post|Put|Delete|Patch)Mapping\s*\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"([^\"]*)\"")
CALL = re.compile(r"\b(\w+)\.(\w+)\s*\(")
SCHEMA = "kind string, path string, subject string, predicate string, value string, confidence double, line int"


def parse(path: str, text: str) -> list[tuple]:
    """Rows (kind, path, subject, predicate, value, confidence, line): entity, fact, relation."""
    text = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text or "", flags=re.S)
    package = m[1] if (m := re.search(r"^\s*package\s+([\w.]+)\s*;", text, re.M)) else ""
    line = lambda at: text.count("\n", 0, at) + 1
    out: list[tuple] = []
    types = [(m.start(), f"{package}.{m[3]}" if package else m[3], m) for m in TYPE.finditer(text)]
    for at, name, m in types:
        n = line(at)
        out.append(("entity", path, name, m[2], m[3], 1.0, n))
        if package:
            out.append(("fact", path, name, "package", package, 1.0, n))
        out.extend(("fact", path, name, "annotation", f"@{a[1]}", 0.9, n) for a in ANNOTATION.finditer(m[1]))
        out.extend(("fact", path, name, "http_mapping", p, 0.95, n) for p in MAPPING.findall(m[1]))
        for word in ("extends", "implements"):
            if found := re.search(rf"\b{word}\s+([\w.<>, ]+?)(?=\s+(?:extends|implements|permits)\b|$)", m[4].strip()):
                out.extend(("relation", path, name, word, re.sub(r"<.*", "", t).strip(), 0.9, n) for t in re.sub(r"<[^>]*>", "", found[1]).split(",") if t.strip())
    methods = list(METHOD.finditer(text))
    fields = {f: t for t, f in re.findall(r"(?:private|protected)\s+(?:static\s+|final\s+)*([A-Z]\w*)(?:<[^;=]*>)?\s+(\w+)\s*[;=]", text)}
    for i, m in enumerate(methods):
        owner = next((name for at, name, _ in reversed(types) if at < m.start()), package)
        name, n = f"{owner}.{m[3]}", line(m.start(3))
        out.append(("entity", path, name, "method", m[3], 1.0, n))
        out.append(("fact", path, name, "signature", f"{m[2].strip()} {m[3]}({' '.join(m[4].split())})", 1.0, n))
        out.append(("relation", path, owner, "declares_method", name, 1.0, n))
        out.extend(("fact", path, name, "annotation", f"@{a[1]}", 0.9, n) for a in ANNOTATION.finditer(m[1]))
        out.extend(("fact", path, name, "http_mapping", p, 0.95, n) for p in MAPPING.findall(m[1]))
        body = text[m.end() : methods[i + 1].start() if i + 1 < len(methods) else len(text)]
        for target, called in dict.fromkeys(CALL.findall(body)):
            known = fields.get(target)
            out.append(("relation", path, name, "calls", f"{known or target}.{called}", 0.8 if known else 0.5, n))
    return out


def extract(files: DataFrame) -> DataFrame:
    """The graph rows of files (path, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for p, t in zip(frame["path"], frame["text"], strict=True) for r in parse(p, t)], columns=["kind", "path", "subject", "predicate", "value", "confidence", "line"])

    return files.select("path", "text").mapInPandas(run, SCHEMA)
