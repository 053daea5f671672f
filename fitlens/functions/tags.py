"""Keyword, domain, entity and verb tags, and skill overlap."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from fitlens.functions.text import _as_column, contains_any, let
from fitlens.lexicon import DEFAULT_LEXICON, ENTITY_SKILL_LABELS, VERB_EXCEPTIONS, VERB_RULES, Lexicon

TOKEN = r"[\p{L}\p{N}]++(?:[-'][\p{L}\p{N}]++)*+"


def _java_quote(word: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", word)


def keyword_hits(text: Column | str, words: Sequence[str], match: str = "substring") -> Column:
    """Words found in the text, spelled as at their first case-insensitive occurrence,
    sorted and unique.

    Where lower-casing kept the text's length, the spelling is cut out at the position of
    the hit; only the few other texts (a letter that lowers to two) need a regex.
    ``match='word'`` asks for whole words instead of substrings."""
    if match not in ("substring", "word"):
        raise ValueError(f"unknown match {match!r}")
    text = _as_column(text)

    def spelled(row: Column, word: str) -> Column:
        quoted = _java_quote(word)
        if match == "word":
            hit = F.regexp_extract(row["text"], rf"(?iu)(?<!\w){quoted}(?!\w)", 0)
        else:
            hit = F.when(row["aligned"], F.substring(
                row["text"], F.instr(row["low"], word), F.lit(len(word)))
            ).otherwise(F.regexp_extract(row["text"], f"(?iu){quoted}", 0))
        return F.when(F.contains(row["low"], F.lit(word)), hit)

    row = let(F.lower(text), lambda low: F.struct(
        text.alias("text"), low.alias("low"), (F.length(low) == F.length(text)).alias("aligned")))
    found = let(row, lambda r: F.array(*[spelled(r, w) for w in words]))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != ""))))


def profile_skills(text: Column | str, words: Sequence[str] = DEFAULT_LEXICON.profile_skills) -> Column:
    """List words present in the text, in list order and list spelling."""
    return let(F.lower(_as_column(text)), lambda low: F.array_compact(
        F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in words])))


def domain_tags(text: Column | str, domains: Mapping[str, Sequence[str]] | None = None) -> Column:
    """All domains with at least one matching word, sorted. The names are sorted when the
    expression is built, so the rows need no sort."""
    domains = DEFAULT_LEXICON.tag_domains if domains is None else domains
    return let(F.lower(_as_column(text)), lambda low: F.array_compact(
        F.array(*[F.when(contains_any(low, domains[name]), name) for name in sorted(domains)])))


def tokens(text: Column | str) -> Column:
    """Word tokens in text order."""
    return F.regexp_extract_all(_as_column(text), F.lit(TOKEN), F.lit(0))


def _string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def entity_map(words: Column | str, entities: Mapping[str, str], text: Column | str | None = None) -> Column:
    """Label to sorted distinct names, for names of a small in-plan lexicon.

    Single words: ``array_intersect`` hashes both sides, so a row costs its token count
    plus the lexicon size. Longer names are looked up in the blank-joined tokens. Names with
    punctuation (``Node.js``, ``C++``) are looked up by their words, as texts are cut into words too,
    and must be in ``text`` as they are written; without ``text`` they are not found. Large gazetteers
    go through ``operators.gazetteer.tag_entities``."""
    return let(_as_column(words), lambda w: _entity_map(w, entities, text))


def _entity_map(words: Column, entities: Mapping[str, str], text: Column | str | None) -> Column:
    token = regex.compile(TOKEN)
    labels = sorted(set(entities.values()))
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    runs = {n: " ".join(token.findall(n)) for n in sorted(entities)}
    multi = [n for n in runs if runs[n] == n and " " in n]
    written = [n for n in runs if runs[n] and runs[n] != n and text is not None]
    singles = F.array_intersect(words, _string_array([n for n in runs if runs[n] == n and " " not in n]))
    longer = let(joined, lambda j: F.array_compact(F.array(
        *[F.when(F.contains(j, F.lit(f" {n} ")), n) for n in multi],
        *[F.when(F.contains(j, F.lit(f" {runs[n]} ")) & F.contains(_as_column(text), F.lit(n)), n) for n in written]).cast("array<string>")))

    def by_label(found: Column) -> Column:
        entries = F.array(*[
            F.struct(F.lit(label).alias("key"), F.array_sort(F.array_intersect(found, _string_array(
                sorted(n for n, of in entities.items() if of == label)))).alias("value")) for label in labels])
        return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))

    return let(F.concat(singles, longer), by_label)


def entity_skills(entities: Column | str, marks: Sequence[str] = DEFAULT_LEXICON.entity_skill_marks,
                  labels: Sequence[str] = ENTITY_SKILL_LABELS) -> Column:
    """Entity names of the given labels that look like technologies."""
    entities = _as_column(entities)
    empty = F.array().cast("array<string>")
    names = F.concat(*[F.coalesce(F.try_element_at(entities, F.lit(label)), empty) for label in labels])
    return F.filter(names, lambda n: let(F.lower(n), lambda low: contains_any(low, marks)))


def action_verbs(words: Column | str, forms: Mapping[str, str]) -> Column:
    """Lemmas of the verb forms present, sorted and unique."""
    low = F.transform(_as_column(words), F.lower)
    present = F.array_intersect(low, _string_array(sorted(forms)))
    table = F.create_map(*[F.lit(x) for pair in sorted(forms.items()) for x in pair])
    return F.array_sort(F.array_distinct(F.transform(present, lambda f: F.element_at(table, f))))


def verb_lemma(word: Column, rules: Sequence[tuple[str, str, str]] = VERB_RULES,
               exceptions: Mapping[str, str | None] = VERB_EXCEPTIONS) -> Column:
    """Lemma of a lower-case gerund or past form by ordered suffix rules; null if the word is no such form,
    or if what is left of it is no syllable. A native expression: no rule is tried after one that fits."""
    out = None
    for test, off, put in rules:
        fits, lemma = word.rlike(test), F.regexp_replace(word, off, put)
        out = F.when(fits, lemma) if out is None else out.when(fits, lemma)
    cut = F.when(out.rlike(r"^.*[aeiouy].*$") & (F.length(out) >= 3), out)
    known = F.create_map(*[F.lit(x) for pair in sorted(exceptions.items()) for x in (pair[0], pair[1] or "")])
    exception = F.try_element_at(known, word) if exceptions else F.lit(None).cast("string")
    return F.when(exception.isNotNull(), F.nullif(exception, F.lit(""))).otherwise(cut)


def unseen_verbs(words: Column | str, forms: Mapping[str, str], rules: Sequence[tuple[str, str, str]] = VERB_RULES,
                 exceptions: Mapping[str, str | None] = VERB_EXCEPTIONS) -> Column:
    """Lemmas, sorted and unique, of the gerunds and past forms that a verb list (form to lemma) lacks. Each
    different word of a text is looked at once."""
    low = F.array_distinct(F.transform(_as_column(words), F.lower))
    likely = F.filter(F.array_except(low, _string_array(sorted(forms))), lambda w: w.rlike("(?:ing|ed)$"))
    found = F.transform(likely, lambda w: verb_lemma(w, rules, exceptions))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def extracted_skills(text: Column | str, entities: Column | str,
                     lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Keyword skills and technology-like entities together."""
    return F.array_sort(F.array_union(
        keyword_hits(text, lexicon.posting_skills), entity_skills(entities, lexicon.entity_skill_marks)))


def _lowered(profile: Column | str) -> Column:
    return F.transform(_as_column(profile), F.lower)


def matched_skills(job: Column | str, profile: Column | str) -> Column:
    """Posting skills the profile has, compared without case; spelling, order and
    duplicates of the posting side stay."""
    job = _as_column(job)
    return let(_lowered(profile), lambda p: F.filter(job, lambda s: F.array_contains(p, F.lower(s))))


def missing_skills(job: Column | str, profile: Column | str) -> Column:
    """Posting skills the profile lacks, by the same rules."""
    job = _as_column(job)
    return let(_lowered(profile), lambda p: F.filter(job, lambda s: ~F.array_contains(p, F.lower(s))))


def mention_ratio(texts: Column | str, profile: Column | str) -> Column:
    """Share of the texts that mention one of the profile's skills, compared without case; 0.0
    where there are no texts."""
    texts = F.coalesce(_as_column(texts), F.array().cast("array<string>"))
    hits = let(_lowered(profile), lambda p: F.size(F.filter(texts, lambda t: F.exists(p, lambda s: F.contains(F.lower(t), s)))))
    return F.coalesce(F.try_divide(hits, F.size(texts)).cast("double"), F.lit(0.0))


def match_ratio(matched: Column | str, job: Column | str) -> Column:
    """Share of posting skills that matched; 0.0 for a posting without skills."""
    share = F.try_divide(F.size(_as_column(matched)), F.size(_as_column(job)))
    return F.coalesce(share.cast("double"), F.lit(0.0))
