"""SQL fragments shared by the reference queries (DuckDB dialect)."""

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
BREAK = r"[.!?]\s+|\n"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def key(x: str) -> str:
    return f"replace(lower(nfc_normalize({x})), 'ß', 'ss')"


def sentences(table: str = "documents", columns: str = "doc_id, lang, source", name: str = "sent") -> str:
    parts = f"regexp_split_to_array(text, '{BREAK}')"
    return f"""{name} AS (SELECT {columns}, pos, sentence FROM (
        SELECT {columns}, pos, {collapse('raw')} AS sentence FROM (
            SELECT {columns}, unnest({parts}) AS raw, unnest(range(0, len({parts}))) AS pos FROM {table}))
        WHERE sentence <> '')"""


ABBREVIATION = r"""(regexp_matches(sentence, '(^|[^\p{L}])\p{L}\.\p{L}')
    OR regexp_matches(sentence, '(^|[^\p{L}])\p{Lu}\p{L}{0,2}\.\s')
    OR (regexp_matches(sentence, '^[^\p{L}]*\p{Lu}') AND regexp_matches(sentence, '\.\s+\p{Ll}'))
    OR regexp_matches(sentence, '(^|\s)[^\s\p{Ll}\p{Lu}]*\p{Lu}[^\s\p{Ll}\p{Lu}]*\p{Lu}[^\s\p{Ll}]*(\s|$)'))"""
MIXED = r"""(regexp_matches(sentence, '\p{Latin}')
    AND regexp_matches(regexp_replace(sentence, '\p{Latin}', '', 'g'), '\p{L}'))"""
URL = r"regexp_matches(sentence, '(?i)https?://|www\.|\.(com|org|net|edu|gov)([^\p{L}\p{N}_]|$)|@')"
SYMBOL = r"regexp_matches(sentence, '[#%&*/\\_|~\[\]{}<>§¶†‡•@^`=+]|\p{S}')"
DIGIT = r"regexp_matches(sentence, '\p{N}')"
WORDS = "len(string_split(sentence, ' '))"


def reason(low: str = "4", high: str = "25") -> str:
    return f"""CASE WHEN {WORDS} < {low} THEN 'too_short' WHEN {WORDS} > {high} THEN 'too_long'
        WHEN {DIGIT} THEN 'digit' WHEN {URL} THEN 'url' WHEN {SYMBOL} THEN 'symbol'
        WHEN {ABBREVIATION} THEN 'abbreviation' WHEN {MIXED} THEN 'mixed_script' END"""


def kept(high: str = "25", name: str = "kept") -> str:
    """Needs ``sent``: first copies of accepted sentences with their hash."""
    return f"""classified AS (SELECT *, {reason('4', high)} AS reason, sha1({key('sentence')}) AS hash FROM sent),
        {name} AS (SELECT * FROM classified WHERE reason IS NULL
            QUALIFY row_number() OVER (PARTITION BY lang, hash ORDER BY doc_id, pos) = 1)"""


UNIT = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


def unit(x: str) -> str:
    return UNIT.format(x)
