r"""Format-preserving pseudonyms by a keyed Feistel network, in SQL expressions only.

Validated items are replaced within their format: payment card numbers (13 to 19 digits,
Luhn), IBANs (mod 97), social security numbers (those that can be given out), phone numbers,
IPv4 addresses (octets up to 255), dates (ISO, d/m/y, d.m.y; real days of 1900 to 2099),
mail addresses (the part before @; domains stay in clear) and quoted access tokens. Digits
stay digits, letters stay letters of their case, separators stay; check digits are computed
anew, and security numbers and dates are permuted among the valid ones. Of digits that fail
validation as a whole, the longest run of separated groups that passes is taken; what fails
is left alone. The key is the caller's: whoever has it can invert every pseudonym, and as
part of the expressions it can be read in query plans.

The network splits an item's characters into halves and shifts, in each of ROUNDS rounds,
the characters of one half within their class by SHA-256 of key, kind, round, position and
the other half. It is a permutation, so equal values get equal pseudonyms in every
document and different values different ones. Characters that separate parts of an item
are taken out first, so 4111 1111 ... and 41111111... stay linked.

Items are cut out by one regular expression, replaced by array functions and joined with
what stands between them; all of this runs inside the JVM on whole texts of any length.

Edge cases: a null text stays null; an empty one stays empty; texts without items are
returned as they are; repeated rows are changed alike; all columns of the input are kept
(see pseudonymised() for clashing names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73049

KINDS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "token": r"(?<=(?:token|secret|key|password)[ ]{0,2}[=:][ ]{0,2}[\"'])[A-Za-z0-9_\-]{16,}+(?=[\"'])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|(?<=[ .-])[0-9]{3}|(?<![0-9 .-])[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: Without one of these no item can be there, and the text is passed on unread.
HINT = r"@|[0-9]{3}|[0-9]\.[0-9]|[\"'][A-Za-z0-9_\-]{16}"
ITEM = "|".join(KINDS.values())


def session_key(spark: SparkSession) -> str:
    """The session's secret; without one, a word that protects nothing, so that queries run on test tables."""
    return spark.conf.get("spark.tesserae.pii.key", "no secret")


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """body with name bound to value, so that value is written and computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def shifted(key: str, half: str, other: str, kind: str, number: str) -> str:
    """half with each character moved on within its class by a keyed hash of the other half."""
    amount = f"cast(conv(substr(sha2(concat_ws('|', {literal(key)}, '{kind}', {number}, p, {other}), 256), 1, 12), 16, 10) as bigint)"
    one = f"substr({half}, p, 1)"
    moved = lambda low, size: f"char(pmod(ascii({one}) - {low} + {amount}, {size}) + {low})"
    by_class = f"case when {one} between '0' and '9' then {moved(48, 10)} when {one} between 'a' and 'z' then {moved(97, 26)} when {one} between 'A' and 'Z' then {moved(65, 26)} else {one} end"
    if kind == "token":  # hexadecimal tokens stay hexadecimal
        hexed = f"substr('0123456789abcdef', pmod(instr('0123456789abcdef', {one}) - 1 + {amount}, 16) + 1, 1)"
        by_class = f"case when instr('0123456789abcdef', {one}) > 0 and hexa then {hexed} else {by_class} end"
    return f"array_join(transform(sequence(1, length({half})), p -> {by_class}), '')"


def feistel(key: str, value: str, kind: str) -> str:
    """The permutation of a string; a single character is shifted."""
    left, right = "substr(s, 1, h)", "substr(s, h + 1)"
    turn = f"case when k % 2 = 0 then concat({shifted(key, left, right, kind, 'k')}, {right}) else concat({left}, {shifted(key, right, left, kind, 'k')}) end"
    body = f"aggregate(sequence(0, {ROUNDS - 1}), v, (s, k) -> {let('h', 'cast(length(s) div 2 as int)', turn)})"
    if kind == "token":
        body = let("hexa", "v rlike '^[0-9a-f]+$'", body)
    alone = "v" if kind == "token" else shifted(key, "v", "''", kind, "'alone'")
    return let("v", value, f"case when length(v) < 2 then {alone} else {body} end")


def template(item: str, plain: str) -> str:
    """item with its letters and digits replaced, in order, by the characters of plain."""
    return let("q", plain, f"array_join(transform(sequence(1, length({item})), i -> case when substr({item}, i, 1) rlike '[A-Za-z0-9]' then substr(q, length(regexp_replace(substr({item}, 1, i), '[^A-Za-z0-9]', '')), 1) else substr({item}, i, 1) end), '')")


def luhn(digits: str) -> str:
    """The Luhn sum of a string of digits, its last one not doubled."""
    return f"aggregate(sequence(1, length({digits})), 0, (t, j) -> t + {let('d', f'cast(substr({digits}, length({digits}) + 1 - j, 1) as int) * (2 - j % 2)', 'd - 9 * cast(d > 9 as int)')})"


def mod97(text: str) -> str:
    """An account number, letters as 10 to 35, modulo 97."""
    one = f"substr({text}, j, 1)"
    return f"aggregate(sequence(1, length({text})), 0, (t, j) -> cast(case when {one} between '0' and '9' then (t * 10 + ascii({one}) - 48) % 97 else (t * 100 + ascii({one}) - 55) % 97 end as int))"


def parts(item: str, valid: str, one: str, least: int) -> str:
    """item with the longest run of its separated groups that is valid, if any, replaced; valid and one are expressions of x and z.

    x is a run with its separators and z the run without them.
    """
    begins = f"filter(sequence(1, length({item})), i -> i = 1 or substr({item}, i - 1, 1) in (' ', '-'))"
    ends = f"filter(sequence(1, length({item})), i -> i = length({item}) or substr({item}, i + 1, 1) in (' ', '-'))"
    runs = f"flatten(transform({begins}, b -> transform(filter({ends}, e -> e - b >= {least - 1}), e -> struct(e - b + 1 as n, -b as b))))"
    bound = lambda body: let("x", f"substr({item}, -r.b, r.n)", let("z", "regexp_replace(x, '[^A-Za-z0-9]', '')", body))
    best = f"array_max(filter({runs}, r -> {bound(valid)}))"
    put = f"concat(substr({item}, 1, -r.b - 1), {bound(one)}, substr({item}, r.n - r.b))"
    return let("r", best, f"case when r is null then {item} else {put} end")


def pseudonym(key: str, item: str) -> str:
    """The SQL expression that replaces one item of the text."""
    bare = f"regexp_replace({item}, '[^A-Za-z0-9]', '')"
    whole = lambda kind: "^(?:" + KINDS[kind].replace("(?<![A-Za-z0-9._%+-])", "") + ")$"
    card_digits = let("y", feistel(key, "substr(z, 1, length(z) - 1)", "card"), f"concat(y, cast(pmod(-({luhn("concat(y, '0')")}), 10) as string))")
    card = parts(item, f"length(z) between 13 and 19 and {luhn('z')} % 10 = 0", template("x", card_digits), 13)
    iban_body = let("y", feistel(key, "substr(z, 5)", "iban"), f"concat(substr(z, 1, 2), lpad(cast(98 - {mod97("concat(y, substr(z, 1, 2), '00')")} as string), 2, '0'), y)")
    iban = parts(item, f"z rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{8,30}}$' and {mod97('concat(substr(z, 5), substr(z, 1, 4))')} = 1", template("x", iban_body), 12)
    octets = f"split({item}, '[.]')"
    ip_hex = f"array_join(transform({octets}, o -> lpad(hex(cast(o as int)), 2, '0')), '')"
    ip_round = let("f", f"cast(conv(substr(sha2(concat_ws('|', {literal(key)}, 'ip', k, substr(s, 5)), 256), 1, 8), 16, 10) as bigint)", "concat(substr(s, 5), lower(lpad(hex((cast(conv(substr(s, 1, 4), 16, 10) as bigint) + f) % 65536), 4, '0')))")
    ip_shift = let("v", f"lower({ip_hex})", f"aggregate(sequence(0, {ROUNDS - 1}), v, (s, k) -> {ip_round})")
    ip = f"case when forall({octets}, o -> cast(o as int) <= 255) then " + let("z", ip_shift, "array_join(transform(sequence(1, 7, 2), i -> conv(substr(z, i, 2), 16, 10)), '.')") + f" else {item} end"
    # again and again until the number is one that is given out; 40 steps fail once in 10 ** 38
    given = lambda x: f"not ({x} rlike '^(000|666|9)|^...00|0000$')"
    steps = f"aggregate(sequence(1, 40), concat('-', {bare}), (w, j) -> case when w like '-%' then {let('u', feistel(key, 'substr(w, 2)', 'ssn'), f"case when {given('u')} then u else concat('-', u) end")} else w end)"
    ssn = f"case when {given(bare)} then {template(item, steps)} else {item} end"
    format_ = f"case when {item} like '____-__-__' then 'yyyy-MM-dd' when {item} like '__/__/____' then 'dd/MM/yyyy' else 'dd.MM.yyyy' end"
    day = let("n", f"datediff(to_date(d), date'{FIRST_DAY}')", f"case when n between 0 and {DAYS - 1} then date_format(date_add(date'{FIRST_DAY}', {walk(key, 'n')}), {format_}) else {item} end")
    date = let("d", f"try_to_timestamp({item}, {format_})", f"case when d is null then {item} else {day} end")
    mail = f"concat({feistel(key, f"substring_index({item}, '@', 1)", 'mail')}, '@', substring_index({item}, '@', -1))"
    return (
        f"case when {item} like '%@%' then {mail} when {item} rlike {literal(whole('ip'))} then {ip} "
        f"when {item} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}})$' then {date} "
        f"when {item} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn} when {item} rlike '^[0-9](?:[ -]?[0-9]){{12,18}}$' then {card} "
        f"when {item} rlike '^[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}} ?[A-Z0-9]' and {item} rlike {literal('^(?:' + KINDS['iban'] + ')$')} then {iban} "
        f"when {item} rlike '^[+(0-9]' and {item} rlike '^[+]?[0-9 ().-]+$' then {template(item, feistel(key, bare, 'phone'))} else {feistel(key, item, 'token')} end"
    )


def walk(key: str, n: str) -> str:
    """A keyed permutation of 0 .. DAYS - 1: a Feistel network on 271 times 271, repeated until the number is in range."""
    f = f"cast(conv(substr(sha2(concat_ws('|', {literal(key)}, 'date', k, s % 271), 256), 1, 10), 16, 10) as bigint)"
    once = f"aggregate(sequence(0, {ROUNDS - 1}), cast(w as bigint), (s, k) -> (s % 271) * 271 + (s div 271 + {f}) % 271)"
    # 271 * 271 = 73441: 392 numbers are out of range, so a walk of 12 steps never fails in practice; a failure keeps the day
    return f"cast(aggregate(sequence(1, 12), -1L - cast({n} as bigint), (w0, r) -> case when w0 >= 0 then w0 else {let('w', '-1L - w0', let('u', once, f'case when u < {DAYS} then u else -1L - u end'))} end, w0 -> case when w0 >= 0 then w0 else cast({n} as bigint) end) as int)"


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_items") -> DataFrame:
    """docs with the items of its text replaced and, in the column count, the number of them that changed.

    Columns of docs stay: where it has one of the name count, or count is None, no number is added.
    """
    if not key:
        raise ValueError("a key is needed")
    added = [count] if count and count not in docs.columns else []
    items, new, between, number = (next(n for n in (f"_{x}{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns) for x in ("items", "new", "between", "number"))
    found = docs.withColumn(items, F.when(F.col(text).rlike(HINT), F.expr(f"regexp_extract_all({text}, {literal(ITEM)}, 0)")))
    found = found.withColumn(items, F.when(F.size(items) > 0, F.col(items)))
    found = found.withColumn(new, F.expr(f"transform({items}, m -> {pseudonym(key, 'm')})"))
    found = found.withColumn(between, F.when(F.col(items).isNotNull(), F.expr(f"split({text}, {literal(ITEM)}, -1)")))
    if added:
        changed = F.coalesce(F.expr(f"size(filter(zip_with({items}, {new}, (a, b) -> a <> b), x -> x))"), F.lit(0))
        found = found.withColumn(number, changed.cast("int"))
    joined = f"concat(element_at({between}, 1), array_join(zip_with({new}, slice({between}, 2, size({new})), (a, b) -> concat(a, b)), ''))"
    out = found.withColumn(text, F.when(F.col(items).isNull(), F.col(text)).otherwise(F.expr(joined)))
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return out.select(*kept, *[F.col(number).alias(c) for c in added])
