"""Extractive digests: content test, sentences, terms, best sentence."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.text import collapse, doublings, let, power_of_two, shorten, tidy

# Word lists, patterns and limits that decide the result.
LATIN_WORD = r"[A-Za-z][A-Za-z0-9\-]{1,}"
LOWER_WORD = r"[a-z][a-z0-9\-]++"
CJK_RUN = "[\\u4e00-\\u9fff]+"
SENTENCE = "[^。！？!?；;\\n]+[。！？!?；;]?"
WIDE_ENDS = ("。", "！", "？", "；")
LATIN_SENTENCE = "[^!?;\\n]+[!?;]?"
LEADING_FRAGMENT = "^[\\u4e00-\\u9fff]{1,3}[\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u3000]+(?=[\\u4e00-\\u9fff])"
DEFINITION_MARKERS = ("是指", "指的是", "即为", "定义为")
BOUNDARY_CHARACTERS = "的了和与及或在是为对把被从到就都也而其之等将并且以于由这那有着随需应可很更最使所者我你他们一个等"
STOPWORDS = (
    "的", "了", "和", "与", "及", "或", "在", "是", "为", "对", "把", "被", "从", "到", "就",
    "都", "也", "而", "其", "之", "等", "将", "并", "且", "以", "于", "由", "这", "那", "有",
    "一个", "我们", "他们", "可以", "以及", "通过", "进行", "随着", "不断", "进一步", "目前",
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have",
    "will", "can", "not", "but", "its", "into", "than", "then", "they", "them", "their", "our",
)
MIN_CONTENT_CJK = 4
MIN_CONTENT_WORDS = 3
SUMMARY_CHARACTERS = 80
SENTENCE_CHARACTERS = 6
SENTENCES_CONSIDERED = 12
KEYWORD_CHARACTERS = 8
STRONG_WEIGHT = 3
LONGEST_NGRAM = 5
NGRAM_SPAN_CHARACTERS = 40
KEYWORDS = 5
KEYWORD_SOURCE_CHARACTERS = 600
POSITION_DISCOUNT = 0.05
DEFINITION_FACTOR = 1.35

# Physical only: an interpreted step of a binary search costs as much as comparing dozens of terms.
PLAIN_SEARCH_TERMS = 512

_STRING_ARRAY = "array<string>"


def has_content(text: Column) -> Column:
    """At least four CJK characters, or at least three Latin words."""
    cjk = F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]"))
    return (cjk >= MIN_CONTENT_CJK) | (F.regexp_count(text, F.lit(LATIN_WORD)) >= MIN_CONTENT_WORDS)


def split_sentences(text: Column) -> Column:
    """Up to twelve sentences of at least six characters, whitespace collapsed."""

    def pieces(line: Column) -> Column:
        # A class with CJK members costs ten times as much a character, so texts without them have a pattern of their own.
        wide = reduce(or_, [F.contains(line, F.lit(mark)) for mark in WIDE_ENDS])
        return F.when(wide, F.regexp_extract_all(line, F.lit(SENTENCE), F.lit(0))).otherwise(
            F.regexp_extract_all(line, F.lit(LATIN_SENTENCE), F.lit(0))
        )

    cleaned = F.transform(let(F.replace(text, F.lit("\n"), F.lit(" ")), pieces), tidy)
    return F.slice(
        F.filter(cleaned, lambda s: F.length(s) >= SENTENCE_CHARACTERS), F.lit(1), F.lit(SENTENCES_CONSIDERED)
    )


def _stop(word: Column) -> Column:
    return word.isin(*STOPWORDS)


def _latin_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LOWER_WORD), F.lit(0))


def _told(words: Column) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~_stop(w))


def latin_terms(text: Column) -> Column:
    """Lower-case Latin words of three letters or more that are not stop words, one entry per occurrence."""
    return _told(_latin_words(text))


def _cjk_parts(text: Column) -> Column:
    """``struct<strong, weak>``: CJK spans between function characters, and n-grams of the spans that are too long."""
    spans = F.regexp_extract_all(
        F.regexp_replace(text, f"[{BOUNDARY_CHARACTERS}]", " "), F.lit(CJK_RUN), F.lit(0)
    )

    def both(found: Column) -> Column:
        strong = F.filter(found, lambda s: F.length(s).between(2, KEYWORD_CHARACTERS))
        weak = F.filter(found, lambda s: ~F.length(s).between(2, KEYWORD_CHARACTERS))

        def ngrams(span: Column) -> Column:
            longest = F.when(F.length(span) <= NGRAM_SPAN_CHARACTERS, F.lit(LONGEST_NGRAM)).otherwise(F.lit(2))
            sizes = F.filter(F.sequence(F.lit(2), longest), lambda size: size <= F.length(span))
            return F.flatten(
                F.transform(
                    sizes,
                    lambda size: F.transform(
                        F.sequence(F.lit(1), F.length(span) - size + 1), lambda at: F.substring(span, at, size)
                    ),
                )
            )

        # Spans hold no function character, and every one-character stop word is one.
        candidates = F.filter(
            F.flatten(F.transform(weak, ngrams)),
            lambda gram: ~_stop(gram) & ~F.exists(strong, lambda s: F.contains(s, gram)),
        )
        return F.struct(strong.alias("strong"), candidates.alias("weak"))

    return let(spans, both)


def _cjk_terms(text: Column) -> Column:
    """CJK spans (tripled), then n-grams."""
    return let(
        _cjk_parts(text), lambda p: F.concat(F.flatten(F.array_repeat(p["strong"], STRONG_WEIGHT)), p["weak"])
    )


def terms(text: Column) -> Column:
    """Term list in ranking order of first sight; strong terms appear three times."""
    latin = F.flatten(F.transform(latin_terms(text), lambda w: F.array_repeat(w, STRONG_WEIGHT)))
    return F.when(text.rlike(CJK_RUN), F.concat(latin, _cjk_terms(text))).otherwise(latin)


def distinct_terms(text: Column) -> Column:
    """Each of ``terms`` once."""
    latin = _told(F.array_distinct(_latin_words(text)))
    return F.when(text.rlike(CJK_RUN), F.array_distinct(terms(text))).otherwise(latin)


def term_occurrences(text: Column) -> Column:
    """``array<struct<term, at, weight>>``: the entries of ``terms`` with repeats as weights, ``at`` the first one's place."""

    def placed(words: Column, begin: Column, weight: int, step: int) -> Column:
        return F.transform(
            words,
            lambda w, i: F.struct(
                w.alias("term"), (begin + step * i).alias("at"), F.lit(weight).alias("weight")
            ),
        )

    def with_cjk(latin: Column) -> Column:
        first = F.size(latin) * STRONG_WEIGHT
        return let(
            _cjk_parts(text),
            lambda p: F.concat(
                placed(latin, F.lit(0), STRONG_WEIGHT, STRONG_WEIGHT),
                placed(p["strong"], first, STRONG_WEIGHT, 1),
                placed(p["weak"], first + F.size(p["strong"]) * STRONG_WEIGHT, 1, 1),
            ),
        )

    plain = placed(latin_terms(text), F.lit(0), STRONG_WEIGHT, STRONG_WEIGHT)
    return F.when(text.rlike(CJK_RUN), let(latin_terms(text), with_cjk)).otherwise(plain)


def term_totals(occurrences: Column) -> Column:
    """``array<struct<term, tf, at>>`` of ``term_occurrences``, from run boundaries in their sorted copy."""

    def runs(ordered: Column) -> Column:
        begins = lambda i: (i == 0) | (F.get(ordered, i)["term"] != F.get(ordered, i - 1)["term"])
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), begins)

        def total(start: Column, end: Column) -> Column:
            weights = F.slice(ordered, start + 1, end - start)
            return F.struct(
                F.get(ordered, start)["term"].alias("term"),
                F.aggregate(weights, F.lit(0).cast("bigint"), lambda acc, x: acc + x["weight"]).alias("tf"),
                F.get(ordered, start)["at"].alias("at"),
            )

        def summed(begin: Column) -> Column:
            ends = F.concat(F.slice(begin, F.lit(2), F.size(begin)), F.array(F.size(ordered)))
            return F.zip_with(begin, ends, total)

        return F.when(F.size(ordered) > 0, let(starts, summed))

    return let(F.sort_array(occurrences), runs)


def contenders(totals: Column, limit: int) -> Column:
    """The terms of ``totals`` that ``select_keywords`` can come to, whatever the document frequencies.

    Of the terms counted ``t`` times or more, one that neither contains nor lies in another of them is always chosen,
    unless the list is full. Where there are ``limit`` such terms, no term counted less often is ever looked at.
    """

    def clash(a: Column, b: Column) -> Column:
        return (a["term"] != b["term"]) & (F.contains(a["term"], b["term"]) | F.contains(b["term"], a["term"]))

    def often(all_terms: Column, least: Column) -> Column:
        return F.filter(all_terms, lambda x: x["tf"] >= least)

    def certain(found: Column) -> Column:
        return F.size(F.filter(found, lambda x: ~F.exists(found, lambda y: clash(x, y)))) >= limit

    def cut(all_terms: Column) -> Column:
        counts = F.sort_array(F.array_distinct(F.transform(all_terms, lambda x: x["tf"])))
        above_least = F.slice(counts, F.lit(2), F.size(counts))
        enough = F.filter(above_least, lambda least: let(often(all_terms, least), certain))
        return let(F.coalesce(F.array_max(enough), F.lit(0).cast("bigint")), lambda least: often(all_terms, least))

    return let(totals, cut)


def length_penalty(term: Column) -> Column:
    return F.when(term.rlike(f"^(?:{LATIN_WORD})$"), F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.length(term) - 4)
    )


def term_counts(words: Column) -> Column:
    """``struct<terms, counts>`` of a term array, terms in order, from run boundaries in its sorted copy."""

    def runs(ordered: Column) -> Column:
        begins = lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), begins)

        def counted(at: Column) -> Column:
            ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(ordered)))
            return F.struct(
                F.transform(at, lambda i: F.get(ordered, i)).alias("terms"),
                F.zip_with(ends, at, lambda e, s: (e - s).cast("bigint")).alias("counts"),
            )

        none = F.struct(F.array().cast(_STRING_ARRAY).alias("terms"), F.array().cast("array<bigint>").alias("counts"))
        return F.when(F.size(ordered) > 0, let(starts, counted)).otherwise(none)

    return let(F.sort_array(words), runs)


def count_of(counts: Column, term: Column) -> Column:
    """A term's count, 0 for one that is not there: a plain search in short lists, a binary one in long lists."""

    def nearer(below: Column, step: Column) -> Column:
        further = below + power_of_two(step)
        return F.when(F.get(counts["terms"], further - 1) < term, further).otherwise(below)

    def at(place: Column) -> Column:
        return F.when(F.get(counts["terms"], place) == term, F.get(counts["counts"], place)).otherwise(F.lit(0).cast("bigint"))

    plain = F.coalesce(
        F.get(counts["counts"], F.array_position(counts["terms"], term).cast("int") - 1), F.lit(0).cast("bigint")
    )
    halving = let(F.aggregate(F.reverse(doublings(F.size(counts["terms"]) + 1)), F.lit(0), nearer), at)
    return F.when(F.size(counts["terms"]) <= PLAIN_SEARCH_TERMS, plain).otherwise(halving)


def summarize(text: Column, limit: int = SUMMARY_CHARACTERS) -> Column:
    """The most representative sentence, shortened; the whole text when it has no sentence."""
    return shorten(let(text, _best_sentence), limit, collapsed=True)


def _best_sentence(text: Column) -> Column:
    # Only the start of the text can hold the leading fragment.
    leads = F.left(text, F.lit(1)).between("\u4e00", "\u9fff")
    sentences = split_sentences(F.when(leads, F.regexp_replace(text, LEADING_FRAGMENT, "")).otherwise(text))

    def choose(found: Column) -> Column:
        def ranked(words_of: Callable[[Column], Column], repeats: int, counts: Column) -> Column:
            """``words_of`` gives each term of a sentence once where ``terms`` has it ``repeats`` times."""

            def score(sentence: Column, position: Column) -> Column:
                def total(words: Column) -> Column:
                    hits = F.aggregate(
                        words, F.lit(0).cast("bigint"), lambda acc, w: acc + count_of(counts, w)
                    )
                    weight = (hits * repeats**2) / F.sqrt((F.size(words) * repeats).cast("double"))
                    early = weight * (1.0 - position * POSITION_DISCOUNT)
                    defines = reduce(or_, [F.contains(sentence, F.lit(m)) for m in DEFINITION_MARKERS])
                    value = early * F.when(defines, F.lit(DEFINITION_FACTOR)).otherwise(F.lit(1.0))
                    return F.when(F.size(words) > 0, value)

                return F.struct(
                    let(words_of(sentence), total).alias("score"), (-position).alias("order"), sentence.alias("sentence")
                )

            scored = F.filter(F.transform(found, score), lambda x: x["score"].isNotNull())
            best = F.array_max(scored)["sentence"]
            return F.coalesce(best, F.get(found, F.lit(0)))

        def weighed(whole: Column) -> Column:
            # Without CJK runs every term is strong, so its repeats need not be listed.
            latin = let(term_counts(latin_terms(whole)), partial(ranked, latin_terms, STRONG_WEIGHT))
            return F.when(whole.rlike(CJK_RUN), let(term_counts(terms(whole)), partial(ranked, terms, 1))).otherwise(latin)

        return (
            F.when(F.size(found) == 0, collapse(text))
            .when(F.size(found) == 1, F.get(found, F.lit(0)))
            .otherwise(let(F.array_join(found, " "), weighed))
        )

    return let(sentences, choose)


def select_keywords(ranked: Column, limit: int = KEYWORDS) -> Column:
    """First ``limit`` of a ranked term array, skipping terms that contain, or lie in, one already chosen."""

    def step(chosen: Column, term: Column) -> Column:
        clash = F.exists(chosen, lambda c: F.contains(c, term) | F.contains(term, c))
        return F.when((F.size(chosen) >= limit) | clash, chosen).otherwise(F.array_append(chosen, term))

    return F.aggregate(ranked, F.array().cast(_STRING_ARRAY), step)
