"""SQL statements of the digest rules for Latin text, used by several equivalents."""

from __future__ import annotations

from cartulary.functions.digest import STOPWORDS

_STOP = ", ".join(f"'{word}'" for word in STOPWORDS if word.isascii())
_SENTENCES = "[^。！？!?；;]+[。！？!?；;]?"


def sql_collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def sql_terms(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '[a-z][a-z0-9-]+')"
    return f"list_filter({words}, lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))"


def sql_sentences(text: str) -> str:
    pieces = f"regexp_extract_all(replace({text}, chr(10), ' '), '{_SENTENCES}')"
    return f"list_filter(list_transform({pieces}, lambda p: {sql_collapse('p')}), lambda p: length(p) >= 6)[1:12]"


def sql_shorten(clean: str, limit: int, separators: tuple[str, ...] = ("，", "、", ",", "；", ";", " ")) -> str:
    window = f"substring({clean}, 1, {limit})"
    cases = "".join(
        f" WHEN instr({window}, '{s}') > 0 AND {limit} - instr(reverse({window}), '{s}') >= {limit // 2}"
        f" THEN trim(substring({window}, 1, {limit} - instr(reverse({window}), '{s}')))"
        for s in separators
    )
    return f"CASE WHEN length({clean}) <= {limit} THEN {clean}{cases} ELSE trim({window}) END"


def sql_best_sentences(source: str, key: str) -> str:
    """CTEs ending in ``digest(key, summary)`` for a relation with ``text``."""
    return f"""
bs_pieces AS (SELECT {key}, text, {sql_sentences("text")} AS s FROM {source}),
bs_sentence AS (
  SELECT {key}, i - 1 AS pos, {sql_terms("s[i]")} AS t
  FROM bs_pieces, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
bs_word AS (SELECT {key}, pos, unnest(t) AS term FROM bs_sentence),
bs_total AS (SELECT {key}, term, 3 * count(*) AS n FROM bs_word GROUP BY {key}, term),
bs_score AS (
  SELECT {key}, pos, 3 * sum(n) / sqrt(3.0 * count(*)) * (1.0 - 0.05 * pos) AS score
  FROM bs_word JOIN bs_total USING ({key}, term) GROUP BY {key}, pos),
bs_best AS (
  SELECT {key}, pos FROM bs_score
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, pos) = 1),
bs_chosen AS (
  SELECT {", ".join("p." + k.strip() for k in key.split(","))},
         CASE WHEN len(p.s) = 0 THEN {sql_collapse("p.text")} ELSE p.s[coalesce(b.pos, 0) + 1] END AS c
  FROM bs_pieces p LEFT JOIN bs_best b USING ({key})),
digest AS (SELECT {key}, {sql_shorten("c", 80)} AS summary FROM bs_chosen)"""


def sql_keywords(sections: str, sources: str) -> str:
    """CTEs ending in ``picked(document_id, section_index, keywords)``.

    ``sections`` gives document_id and text for the term statistics, ``sources`` document_id, section_index and
    the keyword source as text. The enclosing WITH must be recursive.
    """
    return f"""
kw_df AS (
  SELECT document_id, term, count(*) AS df
  FROM (SELECT document_id, unnest(list_distinct({sql_terms("text")})) AS term FROM {sections}) GROUP BY ALL),
kw_words AS (
  SELECT document_id, section_index, t[i] AS term, i
  FROM (SELECT document_id, section_index, {sql_terms("text")} AS t FROM {sources}),
  LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)),
kw_tf AS (
  SELECT document_id, section_index, term, count(*) AS tf, min(i) AS pos FROM kw_words GROUP BY ALL),
kw_ranked AS (
  SELECT document_id, section_index, term, row_number() OVER (PARTITION BY document_id, section_index
    ORDER BY tf DESC, coalesce(df, 0) DESC, length(term) DESC, pos) AS r
  FROM kw_tf LEFT JOIN kw_df USING (document_id, term)),
kw_lists AS (
  SELECT document_id, section_index, list(term ORDER BY r) AS terms FROM kw_ranked GROUP BY ALL),
kw_pick(document_id, section_index, terms, i, chosen) AS (
  SELECT document_id, section_index, terms, 1, CAST([] AS VARCHAR[]) FROM kw_lists
  UNION ALL
  SELECT document_id, section_index, terms, i + 1,
         CASE WHEN len(list_filter(chosen, lambda c: contains(c, terms[i]) OR contains(terms[i], c))) > 0
              THEN chosen ELSE list_append(chosen, terms[i]) END
  FROM kw_pick WHERE i <= len(terms) AND len(chosen) < 5),
picked AS (
  SELECT document_id, section_index, array_to_string(chosen, '|') AS keywords
  FROM kw_pick WHERE i > len(terms) OR len(chosen) = 5)"""
