"""Sections, bullets and their classes.

A posting is split into lines once; the first line that names a section opens it
and the section runs to the other section's start or to the end of the text. All of
it happens inside the row, so no step here moves data between partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlens.functions.text import BLANK, SPACE, _as_column, contains_any, let, strip
from fitlens.lexicon import BOILERPLATE_PATTERNS, CONTEXT_CHARS, DEFAULT_LEXICON, Lexicon
from fitlens.operators.rows import each_item

MARKERS = r"(?:[•\-*]|\p{Nd}+[.)]|[a-z][.)])"
WIDE_MARKERS = r"(?:[•\-*◦○▪▫]|\p{Nd}+[.)]|[a-zA-Z][.)])"


@dataclass(frozen=True)
class Parser:
    """Rules by which a description is cut into sections and items.

    With ``subsections``, headings such as ``Preferred:`` decide which qualifications are bonus
    items; with ``boilerplate``, the summary loses its standard passages; with ``confidence``, a
    score is kept for every item. Items below ``min_confidence`` are left out."""
    mode: str = "phrase"
    summary_mode: str = "sequential"
    markers: str = MARKERS
    subsections: bool = False
    boilerplate: bool = False
    confidence: bool = False
    min_confidence: float = 0.0


BASIC = Parser()
ENHANCED = Parser("regex", "complement", WIDE_MARKERS, subsections=True, boilerplate=True, confidence=True)


def _opens(low: Column, lexicon: Lexicon, mode: str) -> tuple[Column, Column]:
    """Whether a lower-cased line names qualifications, and whether it names responsibilities."""
    if mode == "phrase":
        phrases = (*lexicon.qualification_headers, *lexicon.responsibility_headers)
        is_q = contains_any(low, lexicon.qualification_headers)
        is_r = contains_any(low, lexicon.responsibility_headers)
        long_enough = all(len(p.strip()) >= 3 for p in phrases)
    elif mode == "regex":
        is_q = low.rlike("|".join(lexicon.qualification_patterns))
        is_r = low.rlike("|".join(lexicon.responsibility_patterns))
        long_enough = False
    else:
        raise ValueError(f"unknown section mode {mode!r}")
    # A line shorter than three characters never opens a section; a phrase of three or
    # more already implies that.
    if long_enough:
        return is_q, is_r
    enough = F.length(strip(low)) >= 3
    return enough & is_q, enough & is_r


def section_tag(low: Column, lexicon: Lexicon = DEFAULT_LEXICON, mode: str = "phrase") -> Column:
    """``q`` or ``r`` for a lower-cased line that opens a section, otherwise an empty string.

    Qualifications are tried first. ``mode`` is ``phrase`` (substrings) or ``regex``."""
    is_q, is_r = _opens(low, lexicon, mode)
    return F.when(is_q, "q").when(is_r, "r").otherwise("")


def _first_tags(lines: Column, lexicon: Lexicon, mode: str) -> Column:
    """``n, q, r``: the number of lower-cased lines, and the first line (from 1) of each tag or 0. What a
    section is named by is not looked for below the line that opens it."""
    def step(s: Column, line: Column) -> Column:
        is_q, is_r = _opens(line, lexicon, mode)
        tag = (F.when((s["q"] > 0) & (s["r"] > 0), "")
               .when(s["q"] > 0, F.when(is_r, F.when(is_q, "").otherwise("r")).otherwise(""))
               .when(s["r"] > 0, F.when(is_q, "q").otherwise(""))
               .otherwise(section_tag(line, lexicon, mode)))
        return let(tag, lambda t: F.struct(
            (s["n"] + 1).alias("n"), F.when(t == "q", s["n"] + 1).otherwise(s["q"]).alias("q"),
            F.when(t == "r", s["n"] + 1).otherwise(s["r"]).alias("r")))

    return F.aggregate(lines, F.struct(*[F.lit(0).alias(c) for c in "nqr"]), step)


def _head(lines: Column, n: Column) -> Column:
    """The text of the first n lines with its closing line feed."""
    return F.when(n > 0, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n"))).otherwise("")


def _section(lines: Column, start: Column, other: Column) -> Column:
    """Section text, null when the section is absent. An inner section keeps the line
    feed that ends its last line."""
    size = F.size(lines)
    stop = F.when(other > start, other).otherwise(size + 1)
    body = F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), stop - F.greatest(start, F.lit(1))), "\n")
    return F.when(start > 0, F.when(other > start, F.concat(body, F.lit("\n"))).otherwise(body))


def with_sections(df: DataFrame, text: str, lexicon: Lexicon = DEFAULT_LEXICON,
                  mode: str = "phrase", summary_mode: str = "sequential") -> DataFrame:
    """Add ``qual_text``, ``resp_text`` and ``summary``.

    ``summary_mode='sequential'`` keeps the default rule: the sections are visited
    qualifications first whatever their order, so when responsibilities come first the
    summary is the whole text cut in two at the qualifications. ``'complement'`` keeps
    only text outside both sections."""
    if summary_mode not in ("sequential", "complement"):
        raise ValueError(f"unknown summary mode {summary_mode!r}")
    df = df.withColumn("_lines", F.split(F.col(text), "\n", -1))
    df = df.withColumn("_tags", _first_tags(F.split(F.lower(F.col(text)), "\n", -1), lexicon, mode))
    df = df.withColumn("_q", F.col("_tags.q")).withColumn("_r", F.col("_tags.r"))
    lines, q, r = F.col("_lines"), F.col("_q"), F.col("_r")
    first = F.least(F.when(q > 0, q), F.when(r > 0, r))
    outside = F.when(first.isNull(), F.col(text)).otherwise(_head(lines, first - 1))
    summary = outside
    if summary_mode == "sequential":
        tail = F.array_join(F.slice(lines, F.greatest(q, F.lit(1)), F.size(lines)), "\n")
        summary = F.when((r > 0) & (q > r), F.concat(_head(lines, q - 1), F.lit("\n\n"), tail)).otherwise(outside)
    return (
        df.withColumn("qual_text", _section(lines, q, r))
        .withColumn("resp_text", _section(lines, r, q))
        .withColumn("summary", strip(summary))
        .drop("_lines", "_tags", "_q", "_r")
    )


def bullets(text: Column | str, markers: str = MARKERS) -> Column:
    """Bullet texts in order; unmarked lines continue the bullet above them and lines
    before the first bullet are dropped.

    The text is cut in front of every marker, each piece is joined to one line. Work is
    linear in the text however many bullets there are."""
    text = F.coalesce(_as_column(text), F.lit(""))
    start = rf"^[{BLANK}]*+{markers}[{BLANK}]++(?=[^{SPACE}])"
    pieces = F.split(text, rf"(?md)(?={start})", -1)
    items = F.filter(pieces, lambda p: p.rlike(rf"(?d)\A{start[1:]}"))
    # Most items are one line, which nothing has to be joined to.
    return F.transform(F.transform(items, lambda p: strip(F.regexp_replace(p, rf"(?d)\A{start[1:]}", ""))), lambda p: F.when(
        F.contains(p, F.lit("\n")), F.regexp_replace(p, rf"[{BLANK}]*+\n[{SPACE}]*+", " ")).otherwise(p))


def _qualification_class(low: Column, lexicon: Lexicon) -> Column:
    return F.when(contains_any(low, lexicon.bonus_words), "bonus").otherwise("required")


def _skill_type(low: Column, lexicon: Lexicon) -> Column:
    return F.when(contains_any(low, lexicon.soft_skills), "Soft").otherwise("Hard")


def _first_class(low: Column, table, default: str) -> Column:
    """Name of the first class with a matching word, in table order. The words of the class that is the default
    too are looked for only where a later class matches, as they change nothing else."""
    names = list(table)
    at = names.index(default) if default in names[:-1] else len(names)
    rest, later = F.lit(default), names[at + 1:]
    if later:
        chosen = F.when(contains_any(low, table[default]), default)
        for name in later:
            chosen = chosen.when(contains_any(low, table[name]), name)
        rest = F.when(contains_any(low, [w for name in later for w in table[name]]), chosen).otherwise(default)
    for name in reversed([n for n in names[:at] if n != default]):
        rest = F.when(contains_any(low, table[name]), name).otherwise(rest)
    return rest


def qualification_class(text: Column | str, context: Column | str,
                        lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """``bonus`` when the item or its section context holds a bonus word, else ``required``."""
    both = F.lower(F.concat(_as_column(text), F.lit(" "), _as_column(context)))
    return let(both, lambda low: _qualification_class(low, lexicon))


def skill_type(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    return let(F.lower(_as_column(text)), lambda low: _skill_type(low, lexicon))


def ownership_level(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    return let(F.lower(_as_column(text)), lambda low: _first_class(low, lexicon.ownership, "lead"))


def frequency(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    return let(F.lower(_as_column(text)), lambda low: _first_class(low, lexicon.frequency, "regularly"))


def activity_type(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    return let(F.lower(_as_column(text)),
               lambda low: _first_class(low, lexicon.activity_domains, "General"))


def classified_qualifications(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON,
                              markers: str = MARKERS, context_chars: int | None = CONTEXT_CHARS) -> Column:
    """Array of ``{text, skill_type, kind}`` for one qualifications section. Each item is classified
    together with the first ``context_chars`` characters of the section, None for all of it."""
    text = _as_column(text)
    context = F.lower(text if context_chars is None else F.substring(text, 1, context_chars))
    return let(context, lambda ctx: F.transform(
        F.transform(bullets(text, markers), lambda b: F.struct(b.alias("raw"), F.lower(b).alias("low"))),
        lambda p: F.struct(
            p["raw"].alias("text"), _skill_type(p["low"], lexicon).alias("skill_type"),
            let(F.concat(p["low"], F.lit(" "), ctx),
                lambda low: _qualification_class(low, lexicon)).alias("kind"))))


def qualifications_of(items: Column | str, kind: str) -> Column:
    """The ``{text, skill_type}`` items of one kind."""
    return F.transform(
        F.filter(_as_column(items), lambda x: x["kind"] == kind),
        lambda x: F.struct(x["text"].alias("text"), x["skill_type"].alias("skill_type")))


def responsibilities(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON,
                     markers: str = MARKERS) -> Column:
    """Array of ``{activity, ownership_level, frequency, activity_type}``."""
    pairs = F.transform(bullets(text, markers),
                        lambda b: F.struct(b.alias("raw"), F.lower(b).alias("low")))
    return F.transform(pairs, lambda p: F.struct(
        p["raw"].alias("activity"),
        _first_class(p["low"], lexicon.ownership, "lead").alias("ownership_level"),
        _first_class(p["low"], lexicon.frequency, "regularly").alias("frequency"),
        _first_class(p["low"], lexicon.activity_domains, "General").alias("activity_type")))


def parse_description(df: DataFrame, text: str, lexicon: Lexicon = DEFAULT_LEXICON,
                      parser: Parser = BASIC, **changes) -> DataFrame:
    """Add the structured columns of a cleaned description; ``changes`` are fields of the parser
    that differ. The three arrays of confidences are null unless the parser asks for them."""
    parser = replace(parser, **changes)
    df = with_sections(df, text, lexicon, parser.mode, parser.summary_mode)
    classify = subsection_qualifications if parser.subsections else classified_qualifications
    df = df.withColumn("_items", classify("qual_text", lexicon, parser.markers))
    columns = {"qualifications_required": (qualifications_of("_items", "required"), "text", QUALIFICATION_SIGNALS),
               "qualifications_bonus": (qualifications_of("_items", "bonus"), "text", QUALIFICATION_SIGNALS),
               "responsibilities": (responsibilities("resp_text", lexicon, parser.markers), "activity", RESPONSIBILITY_SIGNALS)}
    for name, (items, field, signals) in columns.items():
        if parser.min_confidence > 0:
            items = F.filter(items, lambda x: confidence(x[field], signals) >= parser.min_confidence)
        df = df.withColumn(name, items)
        scores = F.transform(name, lambda x: confidence(x[field], signals)) if parser.confidence else F.lit(None)
        df = df.withColumn(f"{name}_confidence", scores.cast("array<double>"))
    if parser.boilerplate:
        df = df.withColumn("summary", drop_boilerplate("summary"))
    return df.drop("_items", "qual_text", "resp_text")


SUBHEADING = r"(?:required|minimum|must have|essential|preferred|desired|nice to have|bonus)\b[^\n]*:"


def subsection_classes(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON,
                       markers: str = WIDE_MARKERS) -> Column:
    """Array of ``{text, kind}`` in which a heading line such as ``Required:`` or
    ``Preferred:`` decides the class of the bullets below it.

    The section is cut in front of every heading; bullets above the first heading are
    ``required``."""
    text = F.coalesce(_as_column(text), F.lit(""))
    heading = rf"[{BLANK}]*+{SUBHEADING}[{BLANK}]*+$"
    spans = F.split(text, rf"(?mdi)(?=^{heading})", -1)
    classed = F.transform(spans, lambda s: F.struct(
        F.when(s.rlike(rf"(?mdi)\A{heading}")
               & let(F.lower(F.substring_index(s, "\n", 1)),
                     lambda low: contains_any(low, (*lexicon.bonus_words, "desired"))),
               "bonus").otherwise("required").alias("kind"),
        bullets(F.regexp_replace(s, rf"(?mdi)\A{heading}", ""), markers).alias("items")))
    return F.flatten(F.transform(classed, lambda c: F.transform(
        c["items"], lambda i: F.struct(i.alias("text"), c["kind"].alias("kind")))))


def subsection_qualifications(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON,
                              markers: str = WIDE_MARKERS) -> Column:
    """Array of ``{text, skill_type, kind}`` whose kind comes from the heading above the item."""
    return F.transform(subsection_classes(text, lexicon, markers), lambda x: F.struct(
        x["text"].alias("text"), skill_type(x["text"], lexicon).alias("skill_type"), x["kind"].alias("kind")))


def drop_boilerplate(text: Column | str, patterns=BOILERPLATE_PATTERNS) -> Column:
    """Remove equal-opportunity, application and benefits passages from a summary."""
    out = _as_column(text)
    for pattern in patterns:
        out = F.regexp_replace(out, f"(?i){pattern}", "")
    return strip(out)


# Signals that a bullet states a qualification, with weights. The weight of a leading
# imperative is a fixed value; the others are our defaults.
QUALIFICATION_SIGNALS = (
    (r"\d+\+?\s*years?", 0.4),
    (r"degree|diploma|certificat", 0.3),
    (r"experience (?:with|in)", 0.3),
    (r"knowledge of|proficien", 0.3),
    (r"you will|you'll", -0.3),
    (r"^(?:design|build|create|develop|implement|contribute|apply|manage|lead)\b", -0.2),
    (r"responsible for", -0.3),
)
RESPONSIBILITY_SIGNALS = (
    (r"you will|you'll", 0.4),
    (r"^(?:design|build|create|develop|implement|contribute|apply|manage|lead)\b", 0.4),
    (r"responsible for", 0.3),
    (r"\d+\+?\s*years?", -0.3),
    (r"degree|diploma|certificat", -0.3),
    (r"experience (?:with|in)", -0.2),
)


def confidence(text: Column | str, signals=QUALIFICATION_SIGNALS, base: float = 0.3) -> Column:
    """Advisory score in 0..1: a base plus the weights of the signals present."""

    def score(low: Column) -> Column:
        total = F.lit(base)
        for pattern, weight in signals:
            total = total + F.when(low.rlike(pattern), F.lit(weight)).otherwise(F.lit(0.0))
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)

    return let(F.lower(_as_column(text)), score)


LOW_CONFIDENCE = 0.4


def low_confidence_items(parsed: DataFrame, id_col: str = "job_id", threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """``id, kind, pos, text, confidence`` of the items of parsed postings below a threshold, for
    review. Postings parsed without confidences have none."""
    def of(column: str, field: str, kind: str) -> Column:
        return F.transform(F.col(column), lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), x[field].alias("text"),
            F.get(f"{column}_confidence", i).alias("confidence")))

    items = F.concat(of("qualifications_required", "text", "required"), of("qualifications_bonus", "text", "bonus"),
                     of("responsibilities", "activity", "responsibility"))
    low = F.filter(items, lambda x: x["confidence"] < threshold)
    return each_item(parsed, low, [id_col], "_low", "_n").select(id_col, "_low.*")
