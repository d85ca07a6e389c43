"""Text functions as column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which company a file name means.
NAME_STOP_WORDS = ["annual", "report", "quarterly", "current", "form", "corp", "section", "sections", "statement", "income", "q", "k"]
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+"


def once(value: Column, f) -> Column:
    """f of a value that is worked out once a row, also where f asks for it in every step of a loop over an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends; a run inside is looked at from its first character only."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s++", ""), r"(?U)(?<!\s)\s++$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 that no other letter, digit or underscore touches, in order, repeats included.

    The classes of all letters and digits cost three times as much as ASCII ones, so texts in ASCII get a pattern of their own.
    """
    low = F.lower(text)
    plain = F.regexp_extract_all(low, F.lit("(?<![a-z0-9_])[a-z0-9]++(?!_)"), F.lit(0))
    exact = F.regexp_extract_all(low, F.lit(r"(?<![\p{L}\p{N}_])[a-z0-9]++(?![\p{L}\p{N}_])"), F.lit(0))
    return F.when(F.octet_length(low) == F.length(low), plain).otherwise(exact)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(trim(text), SENTENCE_GAP), trim), lambda s: s != "")


def sanitize(text: Column) -> Column:
    """Control characters become spaces."""
    return F.trim(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "))


def preview(text: Column, most: int = 240) -> Column:
    flat = trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def hard_cut(text: Column, most: int = 500) -> Column:
    return F.concat(F.substring(text, 1, most), F.lit("..."))


def prompt_sentence(text: Column, most: int = 500) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, most - 3), r"(?U)\s+$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s, i: F.concat(i.cast("string"), F.lit(": "), s)), "\n")


def context_block(texts: Column, most: int = 2000) -> Column:
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(sanitize(t), 1, most))), "\n\n")


def judge_context(texts: Column, first: int = 3, most: int = 1200) -> Column:
    parts = F.transform(F.slice(texts, 1, first), lambda t, i: F.concat(F.lit("[Context "), (i + 1).cast("string"), F.lit("]\n"), F.substring(t, 1, most)))
    return F.when(F.size(texts) == 0, F.lit("[No retrieved context]")).otherwise(F.array_join(parts, "\n\n"))


def prompt(template: str, **values: Column) -> Column:
    """Fills {name} places of a template."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def normal_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def name_tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, NAME_STOP_WORDS)))


def parsed_breaks(answer: Column, size: Column | None = None, coerce: bool = False) -> Column:
    """Break positions from a model's answer, an object with a list break_after; any other answer gives none.

    A code fence may stand around the object, and of the list whole numbers count, and true and false as 1 and 0. With coerce
    there must be no fence, and every entry is turned to a whole number: fractions lose what is behind the point, strings may
    hold a whole number; one entry that can't be turned, null too, makes the list void.
    """
    fenced = F.regexp_replace(F.get(F.split(answer, "```"), F.lit(1)), "^json", "")
    body = answer if coerce else F.when(F.contains(answer, F.lit("```")), fenced).otherwise(answer)
    entries = F.try_variant_get(F.try_parse_json(body), "$.break_after", "array<variant>")

    def number(e: Column) -> Column:
        kind, of = F.schema_of_variant(e), lambda t: F.try_variant_get(e, "$", t)
        plain = F.when(kind == "BIGINT", of("bigint")).when(kind == "BOOLEAN", of("boolean").cast("bigint"))
        if not coerce:
            return plain
        said = trim(of("string"))
        cut = of("double")
        return F.when(kind == "STRING", F.when(said.rlike("^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(said, F.lit("_"), F.lit("")).try_cast("bigint"))).when(
            kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.when(cut < 0, F.ceil(cut)).otherwise(F.floor(cut)).cast("bigint")
        ).otherwise(plain)

    numbers = F.transform(entries, number)
    usable = F.lit(True) if not coerce else ~F.exists(numbers, lambda b: b.isNull())
    found = F.when(entries.isNotNull() & usable, numbers).otherwise(F.array().cast("array<bigint>"))
    return F.filter(found, lambda b: b.isNotNull() & (b >= 0) & (b < (F.lit(2**31 - 1) if size is None else size))).cast("array<int>")


def safe_file_name(url: Column) -> Column:
    """First 12 digits of the sha256, and the decoded tail of the path; one that doesn't end in .pdf gives way to the digits."""
    digest = F.substring(F.sha2(url, 256), 1, 12)
    raw = F.regexp_extract(url, r"^[^:]+://[^/?#]*(?:[^?#]*/)?([^/?#;]+)(?:;[^/?#]*)?/*(?:[?#]|$)", 1)
    tail = F.coalesce(F.try_url_decode(raw), raw)
    named = F.when(F.lower(tail).endswith(".pdf"), tail).otherwise(F.concat(digest, F.lit(".pdf")))
    return F.concat(digest, F.lit("_"), F.regexp_replace(named, r"[^\p{L}\p{N}._-]", "_"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def squared_l2(a: Column, b: Column) -> Column:
    each = F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of the distinct entries of two arrays; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def array_percentile(values: Column, share: float) -> Column:
    """Percentile of an array with linear interpolation; 0 for an empty one."""
    ordered, rank = F.array_sort(values), (F.size(values) - 1) * F.lit(share)
    low = F.floor(rank).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(a * (1 - (rank - low)) + b * (rank - low))


def message_text(content: Column) -> Column:
    """Text of a message: a JSON list gives its parts, or their `text`, line by line; anything else stays as it is."""
    parts = F.from_json(content, "array<string>")
    said = F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.text"), p))
    return F.when(content.startswith("[") & parts.isNotNull(), F.array_join(said, "\n")).otherwise(content)


def search_report(name: str, hits: Column) -> Column:
    """What a search tool answers: hits is an array of structs of rank, score, source, chunk and text."""
    score = lambda h: F.format_string("%.4f", F.floor(h["score"] * 10000 + 0.5) / 10000)
    line = lambda h: F.concat(F.lit("["), h["rank"].cast("string"), F.lit("] score="), score(h), F.lit(" | source="), F.coalesce(h["source"], F.lit("unknown")), F.lit(" | chunk="), F.coalesce(h["chunk"].cast("string"), F.lit("unknown")), F.lit("\n"), F.coalesce(preview(h["text"], 300), F.lit("")), F.lit("\n-"))
    head = F.concat(F.lit("Top "), F.size(hits).cast("string"), F.lit(f" {name} chunks:\n"))
    return F.when(F.size(hits) == 0, F.lit(f"No relevant chunks found in {name}.")).otherwise(F.concat(head, F.array_join(F.transform(hits, line), "\n")))
