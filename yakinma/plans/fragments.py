"""SQL fragments shared by the check queries: the text functions of the engine, as expressions."""

from __future__ import annotations

from yakinma.functions.text import BOILERPLATE_MARKERS, COMPANY_RESPONSE_MARKERS, STOPWORDS, normalize_python, phrase_python
from yakinma.operators.rules import OTHER, Rules

BLANKS = r"[\s\x{1c}-\x{1f}\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def space(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{BLANKS}', ' ', 'g'))"


def low(x: str) -> str:
    return f"lower(translate({x}, 'Iİ', 'ıi'))"


def norm(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({low(f"nfc_normalize(coalesce({x}, ''))")}), '{BLANKS}', ' ', 'g'))"


def phrase(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({low(f"coalesce({x}, '')")}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '{BLANKS}', ' ', 'g'))"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def py_round(x: str, digits: int = 2) -> str:
    """The exact rounding of ``functions.rounding`` for values that are not negative."""
    s, c = f"{10**digits}e0", "134217729e0"
    hi = lambda v: f"({c} * {v} - ({c} * {v} - {v}))"
    p = f"(v * {s})"
    vh, sh = hi("v"), hi(s)
    e = f"((({vh} * {sh} - {p}) + {vh} * ({s} - {sh}) + (v - {vh}) * {sh}) + (v - {vh}) * ({s} - {sh}))"
    f = f"({p} - floor({p}))"
    up = f"{f} > 0.5e0 OR ({f} = 0.5e0 AND {e} > 0) OR ({f} = 0.5e0 AND {e} = 0 AND floor({p}) % 2 = 1)"
    return let(f"abs(({x})::DOUBLE)", "v", f"(CASE WHEN {up} THEN floor({p}) + 1 ELSE floor({p}) END) / {s}") + f" * (CASE WHEN ({x}) < 0 THEN -1e0 ELSE 1e0 END)"


def sanitize(body: str, response: str | None = None) -> str:
    f, r = low("t"), low(space(response)) if response else "''"
    places = [f"CASE WHEN {r} <> '' THEN strpos({f}, {r}) END", f"CASE WHEN length(trim(substr({r}, 1, 90))) >= 24 THEN strpos({f}, trim(substr({r}, 1, 90))) END"] if response else []
    places += [f"strpos({f}, {lit(m)})" for m in COMPANY_RESPONSE_MARKERS]
    boiler = " OR ".join(f"contains({f}, {lit(m)})" for m in BOILERPLATE_MARKERS)
    cut = f"CASE WHEN i IS NULL THEN t WHEN i = 1 THEN '' ELSE {space("trim(substr(t, 1, i - 1), ' -–—|,;:')")} END"
    at = f"list_min(list_filter([{', '.join(places)}], lambda x: x > 0))"
    return let(space(body), "t", f"CASE WHEN t = '' OR {boiler} THEN '' ELSE {let(at, 'i', cut)} END")


def analysis(title: str, body: str, response: str | None = None) -> str:
    return f"array_to_string(list_filter([{space(title)}, {sanitize(body, response)}], lambda x: x <> ''), ' ')"


WORDS = "[A-Za-zÇĞİIÖŞÜçğıöşü]+"


def raw_tokens(normalized: str, least: int) -> str:
    return f"list_filter(regexp_extract_all({normalized}, '{WORDS}'), lambda w: length(w) >= {least})"


def tokens(normalized: str) -> str:
    stop = strings(sorted({normalize_python(w) for w in STOPWORDS}))
    return f"list_filter({raw_tokens(normalized, 3)}, lambda w: NOT list_contains({stop}, w))"


def rule_values(rules: Rules | None = None) -> str:
    rows = [f"({k}, {lit(c)}, {i}, {lit(p)}, {lit(' ' + phrase_python(p) + ' ')}, {w}e0)" for k, (c, t) in enumerate((rules or Rules.of()).items) for i, (p, w) in enumerate(t)]
    return "(VALUES " + ", ".join(rows) + ") AS r(k, category, i, phrase, look, w)"


def classification(texts: str, rules: Rules | None = None, threshold: float = 2.0) -> str:
    """CTEs ``hits`` and ``cats`` (id, k, category, score, phrases) and ``labels`` (id, categories) over a CTE ``texts`` (id, text)."""
    return f"""hits AS (SELECT id, k, category, i, phrase, w FROM (SELECT id, ' ' || {phrase('text')} || ' ' AS p FROM {texts}) x, {rule_values(rules)} WHERE contains(p, look)),
cats AS (SELECT id, k, category, {py_round('sum(w)')} AS score, list(phrase ORDER BY i) AS phrases FROM hits GROUP BY ALL HAVING sum(w) >= {threshold}e0),
labels AS (SELECT id, coalesce(found, [{lit(OTHER)}]) AS categories, found IS NOT NULL AS classified FROM (SELECT id FROM {texts}) a LEFT JOIN (SELECT id, list(category ORDER BY score DESC, k) AS found FROM cats GROUP BY id) b USING (id))"""


ISO_DAY = r"""CASE WHEN regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}([ T]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?( *(Z|[+-]\d{{2}}:\d{{2}}))?)?')
 AND coalesce(try_cast(substr({0}, 12, 2) AS INT), 0) < 24 AND coalesce(try_cast(substr({0}, 15, 2) AS INT), 0) < 60 AND coalesce(try_cast(substr({0}, 18, 2) AS INT), 0) < 60
 THEN try_cast(substr({0}, 1, 10) AS DATE) + CAST(floor((coalesce(try_cast(substr({0}, 12, 2) AS INT), 0) * 60 + coalesce(try_cast(substr({0}, 15, 2) AS INT), 0)
 - CASE WHEN regexp_matches({0}, '[ T].*[+-]\d{{2}}:\d{{2}}$') THEN (CASE WHEN substr({0}, length({0}) - 5, 1) = '-' THEN -1 ELSE 1 END) * (try_cast(substr({0}, length({0}) - 4, 2) AS INT) * 60 + try_cast(substr({0}, length({0}) - 1, 2) AS INT)) ELSE 0 END) / 1440.0) AS INT) END"""


def iso_day(x: str) -> str:
    return ISO_DAY.format(x)


def sentence_list(x: str) -> str:
    """The sentences of a text as a list: cut behind . ! ? with a blank, and at line ends."""
    marked = f"regexp_replace(regexp_replace(trim(coalesce({x}, '')), '([.!?]){BLANKS}', '\\1' || chr(1), 'g'), '\\s*[\\r\\n]+\\s*', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {space('s')}), lambda s: s <> '')"


def numbered(source: str, columns: str, values: str, name: str) -> str:
    """SELECT of ``columns`` with each element of a list as ``name`` and its place from 0 as ``nth``."""
    return f"SELECT {columns}, nth - 1 AS nth, xs[nth] AS {name} FROM (SELECT *, unnest(range(1, length(xs) + 1)) AS nth FROM (SELECT *, {values} AS xs FROM {source}))"
