"""Byte-pair encoding as DuckDB SQL: the merges themselves, one a step, over the distinct pre-tokens of a table."""

from __future__ import annotations

from lexward.llm import vocabulary

#: White space and pre-tokens as RE2 has them; the last white space of a run goes with what follows, so a run is parted there.
_SPACE = r"[\s\x0b\x{85}\p{Z}]"
_PARTED = rf"({_SPACE})({_SPACE}[^\s\x0b\x{{85}}\p{{Z}}])"
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\x0b\x{{85}}\p{{Z}}\p{{L}}\p{{N}}]+|{_SPACE}+"

#: Stands where runs are parted; a noncharacter, which text that is exchanged doesn't hold.
_MARK = "chr(64976)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def stages(source: str, ranks_path: str = vocabulary.DEFAULT_RANKS) -> list[str]:
    """Common table expressions over source, a query of (key, body): encoded has (key, ids), the ids of each body.

    key must tell rows apart; a null or empty body has no row. The recursion joins, in every word that isn't done, the
    leftmost of its neighbouring pairs of least rank.
    """
    return [
        f"bpe_ranks AS MATERIALIZED (SELECT lower(hex(from_base64(string_split(line, ' ')[1]))) AS token, string_split(line, ' ')[2]::INT AS id FROM read_csv('{ranks_path}', columns = {{'line': 'VARCHAR'}}, delim = '\\0', header = false, quote = '', escape = ''))",
        f"bpe_bodies AS MATERIALIZED ({source})",
        f"bpe_runs AS (SELECT key, unnest(string_split(regexp_replace(body, {_quoted(_PARTED)}, '\\1' || {_MARK} || '\\2', 'g'), {_MARK})) AS run, generate_subscripts(string_split(regexp_replace(body, {_quoted(_PARTED)}, '\\1' || {_MARK} || '\\2', 'g'), {_MARK}), 1) AS r FROM bpe_bodies WHERE body <> '')",
        f"bpe_words AS MATERIALIZED (SELECT key, r, unnest(w) AS word, generate_subscripts(w, 1) AS n FROM (SELECT key, r, regexp_extract_all(run, {_quoted(_WORDS)}) AS w FROM bpe_runs))",
        "bpe_distinct AS (SELECT word, lower(hex(encode(word))) AS h FROM (SELECT DISTINCT word FROM bpe_words))",
        "bpe_known AS MATERIALIZED (SELECT d.word, [t.id] AS ids FROM bpe_distinct d JOIN bpe_ranks t ON t.token = d.h)",
        "bpe_steps AS (SELECT word, regexp_extract_all(h, '..') AS parts, 0 AS step FROM bpe_distinct ANTI JOIN bpe_known USING (word)\n"
        "  UNION ALL SELECT s.word, parts[:m.place - 1] || [parts[m.place] || parts[m.place + 1]] || parts[m.place + 2:], step + 1 FROM bpe_steps s JOIN (\n"
        "    SELECT p.word, arg_min(p.place, (t.id, p.place)) AS place FROM (SELECT word, unnest(list_transform(range(1, len(parts)), lambda i: parts[i] || parts[i + 1])) AS pair, unnest(range(1, len(parts))) AS place FROM bpe_steps WHERE len(parts) > 1) p\n"
        "    JOIN bpe_ranks t ON t.token = p.pair GROUP BY p.word) m ON m.word = s.word)",
        "bpe_merged AS (SELECT word, arg_max(parts, step) AS parts FROM bpe_steps GROUP BY word)",
        "bpe_made AS (SELECT word, list(t.id ORDER BY place) AS ids FROM (SELECT word, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM bpe_merged) JOIN bpe_ranks t ON t.token = part GROUP BY word)",
        "bpe_ids AS MATERIALIZED (SELECT * FROM bpe_known UNION ALL SELECT * FROM bpe_made)",
        "encoded AS MATERIALIZED (SELECT key, flatten(list(ids ORDER BY r, n)) AS ids FROM bpe_words JOIN bpe_ids USING (word) GROUP BY key)",
    ]
