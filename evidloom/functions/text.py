"""Column functions over texts: sections, bounded ranges, identifiers, headings and query terms. All are row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes off, as far as it occurs in a line.
STRIP = r"^[\s]+|[\s]+$"


def normalised(text: Column) -> Column:
    """Line ends as LF, so that offsets count code points of what a reader sees."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def sections(text: Column, patterns: tuple[str, ...]) -> Column:
    """array<struct<start, end, hint>>: a section from each heading line to the next; what is before the first has no hint; a text without headings is one section; empty ones are left out."""
    anchored = "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")" if patterns else None
    size = F.char_length(text).cast("long")
    whole = F.struct(F.lit(0).cast("long").alias("start"), size.alias("end"), F.lit(None).cast("string").alias("hint"))
    if anchored is None:
        return F.filter(F.array(whole), lambda s: s["end"] > s["start"])
    head = "struct<start:bigint,hint:string>"
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{head}>").alias("heads"))

    def step(a: Column, line: Column) -> Column:
        found = F.struct(a["at"].alias("start"), stripped(line).alias("hint"))
        return F.struct(
            (a["at"] + F.char_length(line) + 1).alias("at"),
            F.when(stripped(line).rlike(anchored), F.concat(a["heads"], F.array(found))).otherwise(a["heads"]).alias("heads"),
        )

    def cut(heads: Column) -> Column:
        own = F.transform(heads, lambda h, i: F.struct(h["start"].alias("start"), F.coalesce(F.get(heads, i + 1)["start"], size).alias("end"), h["hint"].alias("hint")))
        before = F.struct(F.lit(0).cast("long").alias("start"), F.coalesce(F.get(heads, F.lit(0))["start"], size).alias("end"), F.lit(None).cast("string").alias("hint"))
        return F.filter(F.concat(F.array(before), own), lambda s: s["end"] > s["start"])

    heads = F.aggregate(F.split(text, "\n"), first, step, lambda a: a["heads"])
    return F.get(F.transform(F.array(heads), cut), F.lit(0))


def bounded(start: Column, end: Column, max_chars: int, overlap_chars: int) -> Column:
    """array<struct<start, end>>: a span cut to pieces of max_chars that overlap; 0 or less: uncut. In closed form, no loop."""
    one = F.array(F.struct(start.alias("start"), end.alias("end")))
    if max_chars <= 0:
        return one
    overlap = max(0, min(overlap_chars, max_chars - 1))
    step, n = max_chars - overlap, end - start
    last = F.ceil((n - overlap) / step).cast("int") - 1
    many = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((start + i * step).alias("start"), F.least(start + i * step + max_chars, end).alias("end")))
    return F.when(n <= max_chars, one).otherwise(many)


def slug(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts joined by |; numbers and ranges by their JSON form."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def span_part(start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), start.cast("string"), F.lit(","), end.cast("string"), F.lit("]"))


def node_id(source: Column, name: Column, node_type: Column) -> Column:
    return F.concat(F.lit("node:"), node_type, F.lit(":"), slug(source, name, node_type))


def edge_id(source: Column, left: Column, right: Column, relation: Column) -> Column:
    return F.concat(F.lit("edge:"), relation, F.lit(":"), slug(source, left, right, relation))


def event_id(source: Column, event_type: Column, actor: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("event:"), event_type, F.lit(":"), slug(source, event_type, actor, span_part(start, end)))


def evidence_id(source: Column, chunk_id: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("evidence:"), slug(source, chunk_id, span_part(start, end)))


def headings(text: Column) -> Column:
    """The Markdown headings of a text in order, without marks."""
    lines = F.filter(F.split(normalised(text), "\n"), lambda x: x.rlike(r"^\s{0,3}#{1,6}\s+\S"))
    return F.transform(lines, lambda x: F.regexp_extract(x, r"^\s{0,3}#{1,6}\s+(.+?)\s*$", 1))


def _folds() -> tuple[str, str]:
    """Letters below U+2000 whose decomposition is one character and marks, and those characters."""
    import unicodedata

    bare = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in range(0xC0, 0x2000)}
    pairs = [(c, b) for c, b in bare.items() if len(b) == 1 and b != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


FOLDS = _folds()


def folded(text: Column) -> Column:
    """Lower case without diacritics, in the JVM: letters that decompose to one character and marks lose the marks; ligatures, which decompose to several, stay (values.without_marks takes them apart, in Python)."""
    bare = F.regexp_replace(F.translate(text, *FOLDS), r"[\x{0300}-\x{036F}]", "")
    return F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(bare))


def folded_words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"(?U)\w+"), F.lit(0))


def has_cjk(term: Column) -> Column:
    return term.rlike(r"[\x{4E00}-\x{9FFF}]")


def segmented(term: Column) -> Column:
    """Pairs of neighbouring characters and the term itself; a term of one character is itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(term) - 1), lambda i: F.substring(term, i, F.lit(2)))
    return F.when(F.char_length(term) <= 1, F.array(term)).otherwise(F.concat(pairs, F.array(term)))


def searchable(term: Column) -> Column:
    """Terms of ASCII letters alone need three or more."""
    return ~(term.rlike("^[A-Za-z]*$") & (F.char_length(term) <= 2))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def query_terms(question: Column) -> Column:
    """The distinct search terms of a question in order: tokens by white space, their words; ideographic tokens by pairs."""
    tokens = F.filter(F.split(question, r"\s+"), lambda t: t != "")
    of_token = lambda t: F.when(has_cjk(t), segmented(t)).otherwise(word_tokens(t))
    return F.array_distinct(F.filter(F.flatten(F.transform(tokens, of_token)), searchable))


def bare_label(label: Column) -> Column:
    return F.regexp_replace(label, "[()]+$", "")


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def safe_segment(value: Column) -> Column:
    """Whether a value can be one segment of a path."""
    return value.isNotNull() & (value != "") & ~value.isin(".", "..") & ~value.rlike(r"[/\\:*?\[\]\x00]")


def relative_path(path: Column) -> Column:
    """A relative path with / between its segments and no . among them; null where it's empty, absolute, wild or leaves its base."""
    flat = F.translate(path, "\\", "/")
    parts = F.filter(F.split(flat, "/"), lambda p: (p != "") & (p != "."))
    bad = (path == "") | flat.startswith("/") | path.rlike(r"[\x00*?\[\]:]") | F.exists(parts, lambda p: p == "..") | (F.size(parts) == 0)
    return F.when(path.isNull() | bad, None).otherwise(F.array_join(parts, "/"))


def portable_key(path: Column) -> Column:
    """A relative path as it is; of an absolute or drive path the last segment."""
    flat = F.translate(path, "\\", "/")
    return F.when(flat.rlike("^(/|[A-Za-z]:)"), F.regexp_extract(flat, "([^/]*)$", 1)).otherwise(flat)
