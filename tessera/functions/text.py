"""Scalar text functions as column expressions; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

# --- fixed values: the patterns of tokens ---------------------------------------------------------------------------------
PATH = r"[A-Za-z0-9_./-]+\.[A-Za-z0-9_./-]+"
CONFIG_KEY = r"[A-Za-z][A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+)+"
CAMEL = r"[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+"
CAMEL_PART = r"[A-Z]?[a-z0-9]+|[A-Z]+(?=[A-Z]|$)"
ASCII = r"[A-Za-z0-9=_-]{2,}"
HAN = r"\p{IsHan}{2,}"
STRING_ARRAY = "array<string>"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def any_of(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def ends_with_any(text: Column, endings: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.endswith(p) for p in endings))


def lower_all(values: Column) -> Column:
    return F.transform(values, F.lower)


def han_grams(text: Column) -> Column:
    """Substrings of 2 to 4 characters of runs of Han characters that hold no stop character."""

    def grams(run: Column) -> Column:
        sizes = F.filter(F.array(*(F.lit(n) for n in (2, 3, 4))), lambda n: F.length(run) >= n)
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))))

    return F.filter(F.flatten(F.transform(found(text, HAN), grams)), lambda t: ~t.rlike(f"[{V.STOP_CHARS}]"))


def tokens(question: Column) -> Column:
    """Ordered distinct tokens: paths, dotted keys, camel-case words with their parts, ASCII words, Han n-grams."""
    q = F.coalesce(question, F.lit(""))
    parts = lambda t: F.filter(lower_all(found(t, CAMEL_PART)), lambda p: F.length(p) >= 2)
    camel = F.flatten(F.transform(found(q, CAMEL), lambda t: F.concat(F.array(F.lower(t)), parts(t))))
    return F.array_distinct(F.concat(lower_all(found(q, PATH)), lower_all(found(q, CONFIG_KEY)), camel, found(F.lower(q), ASCII), han_grams(q)))


def after_comparison(q: Column) -> Column:
    """What follows the first mark of a comparison, if anything does."""
    at = F.instr(q, V.COMPARISON_MARK)
    return F.when((at > 0) & (at - 1 < F.length(q) - 2), F.trim(F.substring(q, at + 2, F.length(q)))).otherwise(q)


def focus(question: Column) -> Column:
    """The part of a question that names its subject: fixed phrases and endings go."""
    q = reduce(lambda x, phrase: F.replace(x, F.lit(phrase), F.lit("")), V.SUBJECT_PHRASES, after_comparison(F.trim(F.coalesce(question, F.lit("")))))
    first, *rest = V.SUBJECT_ENDINGS
    return reduce(lambda x, ending: F.trim(F.regexp_replace(x, ending, "")), rest, F.regexp_replace(q, first, ""))


def is_special(t: Column) -> Column:
    return t.rlike(r"[_\-=/.]")


def is_ascii(t: Column) -> Column:
    return t.rlike(r"^[\x00-\x7F]+$")


def has_han(t: Column) -> Column:
    return t.rlike(r"\p{IsHan}")


def is_generic(t: Column) -> Column:
    return t.isin(V.GENERIC_TOKENS) | (F.length(t) <= 1) | t.startswith("请") | t.endswith("什么") | t.rlike(f"^[{V.GENERIC_CHARS}]+$")


def high_signal(question: Column) -> Column:
    """Tokens of the focus that carry meaning; without any, the first three that aren't generic."""
    kept = lambda t: ~is_generic(t) & ((is_ascii(t) & (F.length(t) >= 4)) | is_special(t) | (has_han(t) & (F.length(t) >= 2)))
    strong = F.filter(tokens(focus(question)), kept)
    return F.when(F.size(strong) > 0, strong).otherwise(F.slice(F.filter(tokens(question), lambda t: ~is_generic(t)), 1, 3))


def token_weight(t: Column) -> Column:
    n = F.length(t)
    return F.when(is_special(t), 6).when(is_ascii(t), F.when(n >= 6, 5).otherwise(4)).when(has_han(t) & (n >= 4), 5).when(has_han(t) & (n == 3), 4).otherwise(3)


def is_entity(t: Column) -> Column:
    return is_special(t) | is_ascii(t)


def is_strong(t: Column) -> Column:
    return is_entity(t) | (has_han(t) & (F.length(t) >= 3))


def intent(question: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    first, *rest = V.INTENTS.items()
    out = F.when(any_of(q, first[1]), first[0])
    for name, words in rest:
        out = out.when(any_of(q, words), name)
    return out.otherwise("GENERAL")


def config_candidates(question: Column) -> Column:
    """Windows of two to four plain tokens, joined by a dot, an underscore, a hyphen."""
    plain = F.filter(tokens(question), lambda t: t.rlike("^[a-z0-9_-]{2,}$"))
    n = F.size(plain)

    def windows(start: Column) -> Column:
        sizes = F.filter(F.array(*(F.lit(k) for k in (2, 3, 4))), lambda k: start + k - 1 <= n)
        return F.flatten(F.transform(sizes, lambda k: F.array(*(F.array_join(F.slice(plain, start, k), sep) for sep in "._-"))))

    return F.when(n < 2, F.array().cast(STRING_ARRAY)).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), windows)))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def is_deep(question: Column) -> Column:
    """Whether a question goes to deep research."""
    q = F.lower(F.coalesce(question, F.lit("")))
    count = lambda text: reduce(lambda a, b: a + b, (occurrences(text, d) for d in V.DELIMITERS))
    first = F.array_min(F.filter(F.array(*(F.instr(q, w) for w in V.COMPARISONS)), lambda i: i > 0))
    listed = F.coalesce((first > 1) & (count(F.substring(q, F.lit(1), first - 1)) >= 2), F.lit(False))
    many = (F.length(q) >= 32) & (count(q) >= 3)
    return (any_of(q, V.COMPARISONS) & (listed | many)) | any_of(q, V.DEEP_WORDS)


def task_type(question: Column) -> Column:
    return F.when(any_of(question, ["区别", "对比"]), "COMPARE").when(any_of(question, ["为什么", "原因"]), "CAUSE").when(any_of(question, ["如何", "策略", "方案"]), "POLICY").otherwise("FACT_LOOKUP")


def split_question(question: Column) -> Column:
    """Up to three partial questions; none for a plain question."""
    q = F.trim(F.coalesce(question, F.lit("")))
    subject = reduce(lambda x, phrase: F.replace(x, F.lit(phrase), F.lit("")), V.SUBJECT_PHRASES[:2], after_comparison(q))
    subject = F.replace(F.trim(F.regexp_replace(subject, V.SUBJECT_ENDINGS[0], "")), F.lit(V.COMPARISON_MARK), F.lit("和"))
    parts = F.filter(F.transform(F.split(subject, "和|与|以及"), lambda x: F.trim(x)), lambda p: F.length(p) > 0)
    compared = F.transform(parts, lambda p: F.concat(p, F.lit(" 的关键结论是什么")))
    both = F.array(F.concat(F.trim(F.replace(q, F.lit("如何"), F.lit(""))), F.lit(" 的原因")), F.concat(F.trim(F.replace(q, F.lit("为什么"), F.lit(""))), F.lit(" 的做法")))
    none = F.array().cast(STRING_ARRAY)
    first = F.when(any_of(q, ["区别", "对比"]), compared).otherwise(none)
    return F.slice(F.when(F.size(first) > 0, first).when(q.contains("为什么") & q.contains("如何"), both).otherwise(none), 1, 3)


def path_key(path: Column) -> Column:
    """A source path without its anchor, with forward slashes."""
    return F.trim(F.substring_index(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "#", 1))


def concept_slug(value: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"[^\p{L}\p{Nd}]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", "default").otherwise(slug)


def ascii_slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_title(slug: Column) -> Column:
    """Slug words with an ASCII first letter capitalised."""
    word = lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)
    return F.array_join(F.transform(F.filter(F.split(slug, "-"), lambda w: w != ""), word), " ")


def referential_keywords(text: Column) -> Column:
    return F.array_distinct(found(text, r"[A-Za-z_][A-Za-z0-9_.-]*=[A-Za-z0-9_.-]+|\b[0-9]{3,5}\b"))


def wiki_target(raw: Column) -> Column:
    return F.trim(F.substring_index(F.substring_index(F.trim(raw), "|", 1), "#", 1))


def content_profile(files: Column, binary: Column) -> Column:
    return F.when((files == 0) | (binary == 0), "DOCUMENT").when(binary * 2 >= files, "ASSET_HEAVY").otherwise("MIXED")


def excerpt(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def json_field(metadata: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(metadata, f"$.{path}"), F.lit(""))


def half_up(x: Column, places: int = 2) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places


def front_matter(markdown: Column, name: str) -> Column:
    """A scalar field of the block between the first two ``---`` lines."""
    block = F.regexp_extract(markdown, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    return F.trim(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*)$", 1))


def front_matter_list(markdown: Column, name: str) -> Column:
    """A list field of the front matter: ``name: [a, "b"]``, lines ``- a`` below ``name:``, or one plain value; blanks and quotes go, an absent field is an empty list."""
    block = F.concat(F.regexp_extract(markdown, r"(?s)\A\s*---\r?\n(.*?)\r?\n---", 1), F.lit("\n"))
    below = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*\r?\n)+)", 1)
    inline = F.trim(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    parts = F.when(below != "", F.transform(F.split(below, r"\r?\n"), lambda x: F.regexp_replace(x, r"^[ \t]*-[ \t]+", ""))).when(inline.rlike(r"^\[.*\]$"), F.split(F.regexp_replace(inline, r"^\[|\]$", ""), ",")).otherwise(F.array(inline))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: F.trim(x) != "")


def with_review_status(markdown: Column, status: Column) -> Column:
    """The same markdown with its review_status line rewritten."""
    return F.regexp_replace(markdown, F.lit(r"(?m)^review_status:.*$"), F.concat(F.lit("review_status: "), status))


def prompt_cut(prompt: Column, system: Column, budget: int) -> Column:
    room = F.greatest(F.lit(0), F.lit(budget) - F.length(system) - 200)
    return F.substring(prompt, F.lit(1), room)


def clamp(limit: int, default: int, most: int) -> int:
    """A caller's limit: the default where it is not positive, at most ``most``."""
    return default if limit <= 0 else min(limit, most)


def vector_literal(values: Column) -> Column:
    """``[x,y,...]`` of an array of numbers; null for none."""
    return F.when(F.size(values) > 0, F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ","), F.lit("]")))


def vector_of(literal: Column) -> Column:
    """The array of a vector literal; null where it isn't one."""
    bare = F.regexp_extract(F.trim(literal), r"^\[(.*)\]$", 1)
    return F.when(bare != "", F.transform(F.split(bare, ","), lambda x: F.trim(x).cast("double")))


def json_has(array: Column, kind: str, name: str, value: Column) -> Column:
    """Whether a JSON array of objects (its schema: kind) has one whose field ``name`` is value."""
    return F.coalesce(F.exists(F.from_json(array, kind), lambda e: e[name].eqNullSafe(value)), F.lit(False))


def json_objects(array: Column) -> Column:
    """The objects of a JSON array as they are written, with all their fields; null where it doesn't parse."""
    return F.from_json(array, "array<string>")


def json_append(array: Column, element: Column) -> Column:
    """The JSON array of objects with one object (a struct) more; null and blank texts count as empty, what doesn't parse stays as it is."""
    empty = F.trim(F.coalesce(array, F.lit(""))) == ""
    old = F.when(empty, F.array().cast("array<string>")).otherwise(json_objects(array))
    return F.when(old.isNull(), array).otherwise(F.concat(F.lit("["), F.array_join(F.array_append(old, F.to_json(element)), ","), F.lit("]")))


def json_remove(array: Column, name: str, value: Column) -> Column:
    """The JSON array without the objects whose field ``name`` is value; null and blank texts become an empty array, what doesn't parse stays as it is."""
    empty = F.trim(F.coalesce(array, F.lit(""))) == ""
    old = F.when(empty, F.array().cast("array<string>")).otherwise(json_objects(array))
    left = F.filter(old, lambda e: ~F.get_json_object(e, f"$['{name}']").eqNullSafe(value.cast("string")))
    return F.when(old.isNull(), array).otherwise(F.concat(F.lit("["), F.array_join(left, ","), F.lit("]")))


def unfenced(text: Column) -> Column:
    """The body of the first code fence of a text; the text itself where no whole fence stands in it."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    body = F.regexp_extract(bare, r"(?s)```[^\n]*\n(.*?)```", 1)
    return F.when(bare.rlike(r"(?s)```[^\n]*\n.*?```"), F.regexp_replace(body, r"^\s+|\s+$", "")).otherwise(bare)
