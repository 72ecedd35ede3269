"""PII: format-preserving Feistel pseudonyms, in SQL expressions only.

Candidates are found by one pattern; each is validated by its kind, and only valid ones are changed:
    card     13 to 19 digits, blanks or hyphens between them, with a right Luhn digit: digits permuted, the Luhn digit made anew; where a candidate
             as a whole has none, the first of its runs of whole groups that has (from the left, the longest first)
    iban     country, check digits and account with remainder 1 modulo 97: account permuted, check digits made anew
    ssn      nnn-nn-nnnn in the issued ranges (area not 000, 666 or 9xx, group not 00, serial not 0000): permuted within the ranges
    phone    with area code in brackets, with a country code, or nnn-nnn-nnnn; codes of the North American plan stay codes of it that begin with 2 to 9,
             other numbers keep two digits and stay outside that plan
    ip       four numbers up to 255: permuted as four bytes
    date     days that exist, of the years 1800 to 2199, year first, day first or month first (day first where both would do): permuted over
             all 146 097 days of those years and written in the same order, with the same separators and number of digits of each part; a date that can
             only be read month first stays one
    email    the part before the @: letters stay letters, digits digits
    key      AKIA and 16 characters; password, token, secret or api_key (in any case) with = or : and at least 8 characters: permuted like e-mail names,
             lower-case hexadecimal ones among lower-case hexadecimal ones

The permutation is an alternating Feistel network over a vector of numbers with given radices: eight rounds, each adding to one half a number
per place drawn from SHA-256 of key, kind, round and the other half, modulo the place's radix. Every round can be undone. Where a format has a
side condition (outside the numbering plan, one digit for a month, not hexadecimal), the permutation is repeated until its image meets it
again: walking along a cycle, which is a permutation of the values that meet the condition. So for a given key each kind is permuted within its own format,
two values never become one, and all can be turned back. Letters are permuted whatever their case, which each place
keeps, so equal values get equal pseudonyms in all documents, whatever their case, separators or order of day and month (unless the format's side condition differs).
The key is a parameter; without it pseudonyms can't be undone.

No grouping and no join: a document's cost is its own length. Nulls: a null text stays null with no values found; empty texts stay empty.
Repeated rows yield equal rows, an empty table an empty result. Columns named as an output are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may be a value; tried in this order at each place of the text. Quantifiers are bounded or possessive, so no text takes more than linear time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}+[A-Za-z]{2,24}",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?i:password|token|secret|api_key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9_-]{8,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+(])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![A-Za-z0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\2[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\3[0-9]{4})(?![0-9])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
}
ANY = "|".join(PATTERNS.values())
#: A text without these has no value.
HINT = r"[0-9@]|AKIA|(?i:password|token|secret|api_key)"
ROUNDS = 8
#: Longest walk along a cycle for a card in a longer run of digits, where the condition holds for a few hundredths of the images at least; elsewhere it holds for a fifth or more.
WALK = 1024
#: Days of the 400 years from 1800-01-01, as 27 x 5411.
DAYS = (27, 5411)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """`body` with `name` bound to `value`, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _feistel(values: str, radices: str, kind: str, key: str, decrypt: bool = False) -> str:
    """SQL: array<bigint> of `values`, permuted; each place stays below its radix."""

    def step(half: str, radix: str, other: str) -> str:
        # 12 hexadecimal digits a place, five places a digest
        digest = f"array_join(transform(sequence(0, greatest(size({half}) - 1, 0) div 5), t -> substr(sha2(concat_ws('|', {_sql(key)}, {_sql(kind)}, k, size(v), t, array_join({other}, ',')), 256), 1, 60)), '')"
        sign = "-" if decrypt else "+"
        return _let(digest, "g", f"transform({half}, (e, i) -> pmod(e {sign} pmod(CAST(conv(substr(g, i * 12 + 1, 12), 16, 10) AS BIGINT), element_at({radix}, i + 1)), element_at({radix}, i + 1)))")

    order = f"sequence({ROUNDS - 1}, 0, -1)" if decrypt else f"sequence(0, {ROUNDS - 1})"
    body = (
        f"aggregate({order}, named_struct('a', slice(v, 1, h), 'b', slice(v, h + 1, size(v) - h)), (s, k) -> if(k % 2 = 0, "
        f"named_struct('a', {step('s.a', 'slice(r, 1, h)', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {step('s.b', 'slice(r, h + 1, size(r) - h)', 's.a')})), s -> concat(s.a, s.b))"
    )
    return _let(f"CAST({values} AS ARRAY<BIGINT>)", "v", _let(f"CAST({radices} AS ARRAY<BIGINT>)", "r", _let("(size(v) + 1) div 2", "h", body)))


def _chars(x: str) -> str:
    return f"filter(split({x}, ''), c -> c <> '')"


def _permute_chars(x: str, kind: str, key: str, decrypt: bool) -> str:
    """SQL: string `x` with letters and digits permuted within their class; letters of both cases are alike and each place keeps its case."""
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 97 WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 65 ELSE 0 END"
    radix = "CASE WHEN c BETWEEN '0' AND '9' THEN 10 WHEN c BETWEEN 'a' AND 'z' OR c BETWEEN 'A' AND 'Z' THEN 26 ELSE 1 END"
    back = "CASE WHEN c BETWEEN '0' AND '9' THEN chr(48 + e) WHEN c BETWEEN 'a' AND 'z' THEN chr(97 + e) WHEN c BETWEEN 'A' AND 'Z' THEN chr(65 + e) ELSE c END"
    moved = _feistel(f"transform(y, c -> {value})", f"transform(y, c -> {radix})", kind, key, decrypt)
    return _let(_chars(x), "y", f"array_join(zip_with(y, {moved}, (c, e) -> {back}), '')")


def _permute_secret(x: str, key: str, decrypt: bool) -> str:
    """SQL: string `x` permuted: one of lower-case hexadecimal digits over all such strings, any other like names, until it is not one of them."""
    hexadecimal = "{} RLIKE '^[0-9a-f]+$'"
    moved = _feistel("transform(y, c -> instr('0123456789abcdef', c) - 1)", "transform(y, c -> 16)", "hex", key, decrypt)
    within = _let(_chars("sx"), "y", f"array_join(transform({moved}, e -> substr('0123456789abcdef', CAST(e AS INT) + 1, 1)), '')")
    return _let(x, "sx", f"if({hexadecimal.format('sx')}, {within}, {_walk('sx', lambda v: _permute_chars(v, 'key', key, decrypt), lambda v: 'NOT ' + hexadecimal.format(v))})")


def _walk(start: str, step: Callable[[str], str], holds: Callable[[str], str], most: int = 256) -> str:
    """SQL: the first of step(start), step(step(start)), ... that `holds`; on a start that holds, a permutation of the values that do."""
    walked = _let(step("wo.x"), "wy", f"named_struct('x', wy, 'done', coalesce({holds('wy')}, false))")
    return f"aggregate(sequence(1, {most}), named_struct('x', {start}, 'done', false), (wo, wk) -> if(wo.done, wo, {walked}), wo -> wo.x)"


def _refill(shape: str, chars: str, cls: str) -> str:
    """SQL: `shape` with its characters of the class `cls` replaced, in order, by those of `chars`."""
    return (
        f"aggregate({_chars(shape)}, named_struct('o', '', 'n', 0), (z, c) -> if(c RLIKE '{cls}', "
        f"named_struct('o', concat(z.o, substr({chars}, z.n + 1, 1)), 'n', z.n + 1), named_struct('o', concat(z.o, c), 'n', z.n)), z -> z.o)"
    )


def _luhn(digits: str, shift: int) -> str:
    """SQL: the weighted digit sum modulo 10; shift 1 leaves room for a check digit."""
    one = f"CAST(substr({digits}, length({digits}) - j + 1, 1) AS INT) * if((j + {shift}) % 2 = 0, 2, 1)"
    return f"(aggregate(sequence(1, length({digits})), 0, (q, j) -> q + if({one} > 9, {one} - 9, {one})) % 10)"


def _card_span(x: str) -> str:
    """SQL: struct (a, b), the first and last place in `x` of its first run of whole groups that is a card number; null if there is none."""
    starts = f"filter(sequence(1, length({x})), cp -> cp = 1 OR substr({x}, cp - 1, 1) IN (' ', '-'))"
    ends = f"filter(sequence(length({x}), 1, -1), cp -> cp = length({x}) OR substr({x}, cp + 1, 1) IN (' ', '-'))"
    spans = f"filter(flatten(transform({starts}, ca -> transform({ends}, cb -> named_struct('a', ca, 'b', cb)))), cs -> cs.b - cs.a >= 12)"
    run = f"regexp_replace(substr({x}, cs.a, cs.b - cs.a + 1), '[^0-9]', '')"
    return f"get(filter({spans}, cs -> {_let(run, 'd', f'length(d) BETWEEN 13 AND 19 AND ' + _luhn('d', 0) + ' = 0')}), 0)"


def _card(m: str, permuted: Callable[[str], str]) -> str:
    """SQL: `m` with its card number permuted until the same run of it would be found again, so that it can be undone."""
    whole = "concat(substr(cm, 1, cn.a - 1), {}, substr(cm, cn.b + 1))"
    walk = whole.format(_walk("substr(cm, cn.a, cn.b - cn.a + 1)", permuted, lambda x: _let(whole.format(x), "cw", f"{_card_span('cw')} = cn"), WALK))
    return _let(m, "cm", _let(_card_span("cm"), "cn", f"if(cn IS NULL, cm, {walk})"))


def _mod97(x: str) -> str:
    return f"aggregate({_chars(x)}, 0, (q, c) -> if(c BETWEEN '0' AND '9', (q * 10 + ascii(c) - 48) % 97, (q * 100 + ascii(c) - 55) % 97))"


def _replacement(m: str, key: str, decrypt: bool) -> str:
    """SQL: struct (kind, value) for the candidate `m`; the kind is null and the value unchanged if no validation holds."""
    feistel = lambda v, r, kind: _feistel(v, r, kind, key, decrypt)
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    alnum = f"regexp_replace({m}, '[^A-Za-z0-9]', '')"
    is_ = lambda kind: f"{m} RLIKE {_sql('^(?:' + _bare(PATTERNS[kind]) + ')$')}"

    email = f"concat({_permute_chars(f'substring_index({m}, chr(64), 1)', 'email', key, decrypt)}, substr({m}, locate(chr(64), {m})))"
    head = f"if({m} LIKE 'AKIA%', 'AKIA', regexp_extract({m}, {_sql(chr(94) + '[A-Za-z_]+' + chr(92) + 's*[=:]' + chr(92) + 's*[' + chr(34) + chr(39) + ']?')}, 0))"
    secret = _let(head, "u", f"concat(u, {_permute_secret(f'substr({m}, length(u) + 1)', key, decrypt)})")

    card_new = _let(_permute_chars("substr(d, 1, length(d) - 1)", "card", key, decrypt), "w", f"concat(w, (10 - {_luhn('w', 1)}) % 10)")
    card = _card(m, lambda x: _let(f"regexp_replace({x}, '[^0-9]', '')", "d", _let(card_new, "f", _refill(x, "f", "[0-9]"))))
    card_ok = f"{_card_span(m)} IS NOT NULL"

    iban_new = _let(_permute_chars("substr(d, 5)", "iban", key, decrypt), "w", f"concat(substr(d, 1, 2), lpad(CAST(98 - {_mod97('concat(w, substr(d, 1, 2), chr(48), chr(48))')} AS STRING), 2, '0'), w)")
    iban = _let(alnum, "d", _let(iban_new, "f", _refill(m, "f", "[A-Za-z0-9]")))
    iban_ok = _let(alnum, "d", f"length(d) BETWEEN 15 AND 34 AND {_mod97('concat(substr(d, 5), substr(d, 1, 4))')} = 1 AND substr(d, 3, 2) BETWEEN '02' AND '98'")

    n = lambda x: f"CAST({x} AS BIGINT)"
    area = f"({n('substr(d, 1, 3)')} - if(substr(d, 1, 3) > '666', 2, 1))"
    ssn_moved = feistel(f"array({area}, ({n('substr(d, 4, 2)')} - 1) * 9999 + {n('substr(d, 6, 4)')} - 1)", "array(898, 99 * 9999)", "ssn")
    ssn_new = _let(ssn_moved, "w", "concat(lpad(CAST(element_at(w, 1) + if(element_at(w, 1) >= 665, 2, 1) AS STRING), 3, '0'), lpad(CAST(element_at(w, 2) div 9999 + 1 AS STRING), 2, '0'), lpad(CAST(element_at(w, 2) % 9999 + 1 AS STRING), 4, '0'))")
    ssn = _let(digits, "d", _let(ssn_new, "f", _refill(m, "f", "[0-9]")))
    ssn_ok = _let(digits, "d", "substr(d, 1, 3) NOT IN ('000', '666') AND substr(d, 1, 1) <> '9' AND substr(d, 4, 2) <> '00' AND substr(d, 6, 4) <> '0000'")

    # North American numbers: the last ten digits, area and exchange from 200 to 999; others: all digits but the first two, walking until they are none of these
    plan_ok = lambda d: f"((length({d}) = 11 AND substr({d}, 1, 1) = '1') OR (length({d}) = 10 AND {m} NOT LIKE '+%')) AND substr({d}, -10, 1) >= '2' AND substr({d}, -7, 1) >= '2'"
    plan = plan_ok("d")
    plan_moved = feistel(f"array({n('substr(d, -10, 3)')} - 200, ({n('substr(d, -7, 3)')} - 200) * 10000 + {n('substr(d, -4, 4)')})", "array(800, 8000000)", "phone")
    plan_new = _let(plan_moved, "w", "concat(substr(d, 1, length(d) - 10), CAST(element_at(w, 1) + 200 AS STRING), CAST(element_at(w, 2) div 10000 + 200 AS STRING), lpad(CAST(element_at(w, 2) % 10000 AS STRING), 4, '0'))")
    far_new = _walk("d", lambda x: f"concat(substr({x}, 1, 2), {_permute_chars(f'substr({x}, 3)', 'phone', key, decrypt)})", lambda x: f"NOT ({plan_ok(x)})")
    phone = _let(digits, "d", _let(f"if({plan}, {plan_new}, {far_new})", "f", _refill(m, "f", "[0-9]")))
    phone_ok = _let(digits, "d", f"length(d) BETWEEN 8 AND 15 AND ({m} LIKE '+%' OR ({plan}))")

    ip = f"array_join({feistel(f'split({m}, {_sql(chr(92) + chr(46))})', 'array(256, 256, 256, 256)', 'ip')}, '.')"
    ip_ok = f"forall(split({m}, {_sql(chr(92) + chr(46))}), o -> CAST(o AS INT) <= 255 AND (o = '0' OR o NOT LIKE '0%'))"

    part = lambda k: f"regexp_extract({m}, '[0-9]+', 0)" if k == 0 else f"element_at(p, {k})"
    parts = f"split({m}, '[-/.]')"
    pad = lambda x: f"lpad({x}, 2, '0')"
    ymd = f"try_to_date(concat_ws('-', {part(1)}, {pad(part(2))}, {pad(part(3))}), 'yyyy-MM-dd')"
    dmy = f"try_to_date(concat_ws('-', {part(3)}, {pad(part(2))}, {pad(part(1))}), 'yyyy-MM-dd')"
    mdy = f"try_to_date(concat_ws('-', {part(3)}, {pad(part(1))}, {pad(part(2))}), 'yyyy-MM-dd')"
    order = f"CASE WHEN length({part(1)}) = 4 THEN if({ymd} IS NOT NULL, 'ymd', '') WHEN {dmy} IS NOT NULL THEN 'dmy' WHEN {mdy} IS NOT NULL THEN 'mdy' ELSE '' END"
    day = f"CASE o WHEN 'ymd' THEN {ymd} WHEN 'dmy' THEN {dmy} WHEN 'mdy' THEN {mdy} END"
    day_no = f"datediff({day}, DATE'1800-01-01')"
    date_ok = _let(parts, "p", _let(order, "o", f"o <> '' AND coalesce({day_no} BETWEEN 0 AND {DAYS[0] * DAYS[1] - 1}, false)"))
    moved = lambda x: _let(feistel(f"array({x} div {DAYS[1]}, {x} % {DAYS[1]})", f"array({DAYS[0]}, {DAYS[1]})", "date"), "w", f"element_at(w, 1) * {DAYS[1]} + element_at(w, 2)")
    to_day = lambda x: f"date_add(DATE'1800-01-01', CAST({x} AS INT))"
    narrow = lambda k, v: f"(length(element_at(p, {k})) = 2 OR {v} < 10)"
    fits = lambda x: _let(to_day(x), "z", f"CASE o WHEN 'ymd' THEN {narrow(2, 'month(z)')} AND {narrow(3, 'day(z)')} WHEN 'dmy' THEN {narrow(1, 'day(z)')} AND {narrow(2, 'month(z)')} ELSE {narrow(1, 'month(z)')} AND day(z) > 12 END")
    sep = f"regexp_extract({m}, '[-/.]', 0)"
    like = lambda k, v: f"lpad(CAST({v} AS STRING), length(element_at(p, {k})), '0')"
    write = (
        f"CASE o WHEN 'ymd' THEN concat_ws({sep}, year(y), {like(2, 'month(y)')}, {like(3, 'day(y)')}) "
        f"WHEN 'dmy' THEN concat_ws({sep}, {like(1, 'day(y)')}, {like(2, 'month(y)')}, year(y)) ELSE concat_ws({sep}, {like(1, 'month(y)')}, {like(2, 'day(y)')}, year(y)) END"
    )
    date = _let(parts, "p", _let(order, "o", _let(f"CAST({day_no} AS BIGINT)", "x", _let(to_day(_walk("x", moved, fits)), "y", write))))

    made = [("email", "true", email), ("key", "true", secret), ("iban", iban_ok, iban), ("phone", phone_ok, phone), ("ssn", ssn_ok, ssn), ("date", date_ok, date), ("ip", ip_ok, ip), ("card", card_ok, card)]
    whens = " ".join(f"WHEN {is_(kind)} AND {ok} THEN named_struct('kind', '{kind}', 'value', {new})" for kind, ok, new in made)
    return f"CASE {whens} ELSE named_struct('kind', CAST(NULL AS STRING), 'value', {m}) END"


def _bare(pattern: str) -> str:
    """The pattern for a whole candidate: without what looks about it; back references count from one."""
    import re

    bare = re.sub(r"\(\?<?!(?:[^()\[\]\\]|\\.|\[[^\]]*\])*\)", "", pattern)
    first = {n: k + 1 for k, n in enumerate(dict.fromkeys(re.findall(r"\\([0-9])", bare)))}
    return re.sub(r"\\([0-9])", lambda m: f"\\{first[m[1]]}", bare)


def pseudonymize(docs: DataFrame, key: str, text: str = "text", *, decrypt: bool = False) -> DataFrame:
    """`docs` with `text` rewritten, `n_values` (int) and `kinds` (their kinds, distinct, sorted, comma-joined).

    With `decrypt` and the same key the rewritten values are turned back.
    """
    rest = docs.drop("n_values", "kinds")
    found = rest.withColumn("__cv_some", F.expr(f"if({_name(text)} RLIKE {_sql(HINT)}, regexp_extract_all({_name(text)}, {_sql(ANY)}, 0), CAST(array() AS ARRAY<STRING>))"))
    found = found.withColumn("__cv_new", F.expr(f"transform(__cv_some, m -> {_replacement('m', key, decrypt)})"))
    joined = f"if(size(__cv_new) = 0, {_name(text)}, array_join(zip_with(split({_name(text)}, {_sql(ANY)}, -1), __cv_new, (g, e) -> concat(g, coalesce(e.value, ''))), ''))"
    kinds = "filter(transform(__cv_new, e -> e.kind), e -> e IS NOT NULL)"
    return found.select(
        *[F.expr(joined).alias(text) if c == text else F.col(_name(c)) for c in rest.columns],
        F.expr(f"coalesce(size({kinds}), 0)").alias("n_values"), F.expr(f"coalesce(array_join(array_sort(array_distinct({kinds})), ','), '')").alias("kinds"),
    )


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"
