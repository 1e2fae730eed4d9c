"""Private values in texts, replaced by pseudonyms of the same format.

Validated values are permuted within their format by a keyed Feistel network
(ROUNDS rounds, alternating between two halves, addition modulo the size of a
half): payment cards that pass the Luhn test give cards that pass it, IPv4
addresses give addresses, social security numbers and dates give valid ones,
phone numbers and other grouped digits keep their layout.  As it is a
permutation, equal values have equal pseudonyms in all documents and different
values have different ones, and who has the key can undo it.  E-mail addresses
and secrets (keys, tokens, passwords) have no validity to keep: their letters
and digits are replaced by keyed ones of the same kind.

Looked for are:

* dates of 1800 to 2199: year first with -, / or . between; day or month first
  with /, . or - and a year of four digits; written with a month's name in
  English (also short), German, French or Spanish.  Year-first and written
  dates share one permutation of the days.  Of numbers that say which one is
  the day (one is above 12) the days above 12 are permuted, others give numbers
  that are a date in both readings;
* phones: + and a country code with groups of three and four digits, or in pairs
  (+33 1 23 45 67 89, +34 612 34 56 78, +41 44 668 18 00); (555) 123-4567 and
  555-123-4567, also with dots or spaces; numbers with a leading 0 in pairs or
  after an area code; Spanish ones of 3 + 2 + 2 + 2 digits;
* cards in one piece, in fours, and as 4-6-5 or 4-6-4, by the Luhn test;
* IBANs of the countries in IBAN_LENGTHS, by their length and mod 97; check
  digits that some countries put inside the account number aren't kept;
* IPv4, and IPv6 in all forms without an embedded IPv4 (of that, the IPv4 part
  is replaced); a pseudonym has all eight groups;
* social security numbers, e-mail addresses, named secrets and AWS key ids.

Everything is one projection of SQL functions: no shuffle, no Python.

Defined cases: a null text gives a null text and no values, an empty text
stays empty, overlapping matches are taken from the left, a number that fails
its test is left as it is, repeated rows give equal results, extra columns are
carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.base import free_name

ROUNDS = 8
KEY = "pseudonym-key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+"
SECRET = (
    r"(?i:(?<![a-z])(?:token|password|passwd|pwd|secret|api[_-]?key))\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_/+.-]{8,}+"
    r"|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
)
DATE = r"(?<![0-9-])[12][0-9]{3}-[01][0-9]-[0-3][0-9](?![0-9-])"
YEAR_FIRST = "|".join(rf"(?<![0-9/.-])[12][0-9]{{3}}{sep}[01]?[0-9]{sep}[0-3]?[0-9](?![0-9/-]|[.][0-9])" for sep in ("/", "[.]"))
DAY_MONTH = "|".join(rf"(?<![0-9/.-])[0-3]?[0-9]{sep}[0-3]?[0-9]{sep}[12][0-9]{{3}}(?![0-9/-]|[.][0-9])" for sep in ("/", "[.]", "-"))
#: Month names, twelve of a style in a row; a name counts for the first style that has it.
MONTHS = (
    "january february march april may june july august september october november december "
    "januar februar märz april mai juni juli august september oktober november dezember "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "jan feb mar apr may jun jul aug sep oct nov dec "
    "jan feb mar apr may jun jul aug sept oct nov dec"
).split()
MONTH = f"(?iu:{'|'.join(sorted(set(MONTHS), key=lambda name: (-len(name), name)))})"
WRITTEN = (
    rf"(?<![0-9A-Za-z.,/-])[0-3]?[0-9](?:st|nd|rd|th|er|[.])?[ ](?:of |de )?{MONTH}[.]?,?[ ](?:of |de )?[12][0-9]{{3}}(?![0-9])"
    rf"|(?<![\p{{L}}0-9]){MONTH}[.]?[ ][0-3]?[0-9](?:st|nd|rd|th)?,?[ ][12][0-9]{{3}}(?![0-9])"
)
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}}+)?::(?:{_HEX}(?::{_HEX}){{0,6}}+)?)(?![0-9A-Za-z:]|[.][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (
    r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\(0\)[ .-]?)?"
    r"(?:[0-9](?:[ .-]?[0-9]{2}){4}|[0-9]{2,3}(?:[ .-][0-9]{2}){3}|[0-9]{2,3}[ .-][0-9]{3}(?:[ .-][0-9]{2}){2}|[0-9]{2,4}[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4})(?![0-9])"
)
#: National numbers by the least first digit after a leading 0 (which stays).
NATIONAL = {
    2: r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}",
    1: r"0[1-9](?:(?:[ .-][0-9]{2}){4}|[0-9]{1,3}[ /-][0-9]{5,8}|[0-9]{1,3}[ -][0-9]{3,4}[ -][0-9]{3,4})",
    6: r"[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}",
}
NATIONAL = {low: rf"(?<![0-9A-Za-z+]|[0-9][ .-])(?:{p})(?![0-9A-Za-z]|[.-][0-9])" for low, p in NATIONAL.items()}
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9A-Za-z])"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG DJ", 25: "LY PT ST",
    26: "IS TR", 27: "BI FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = (
    "(?<![0-9A-Za-z])(?:"
    + "|".join(
        f"(?:{'|'.join(countries.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
        for n, countries in IBAN_LENGTHS.items()
    )
    + ")(?![0-9A-Za-z])"
)
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IBAN, DATE, YEAR_FIRST, DAY_MONTH, WRITTEN, IP, IP6, SSN, PHONE, CARD, *NATIONAL.values()))

#: Days of the Gregorian calendar's 400-year cycle, as a product of two near halves, and its first day here.
CYCLE_HALVES, CYCLE_START = (189, 773), "1800-01-01"
#: The same for the cycle's days above the 12th, and for a year and two numbers up to 12.
HIGH_HALVES, LOW_HALVES = (9, 9833), (240, 240)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(a: str, b: str, size_a: str, size_b: str, key: str) -> str:
    """SQL of struct(a, b) after the rounds; a is below size_a and b below size_b."""
    draw = lambda half: f"cast(conv(substr(sha2(concat_ws('|', {key}, r, {half}, {size_a}, {size_b}), 256), 1, 12), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, r) -> if(r % 2 = 1, "
        f"named_struct('a', (s.a + {draw('s.b')}) % {size_a}, 'b', s.b), named_struct('a', s.a, 'b', (s.b + {draw('s.a')}) % {size_b})))"
    )


def _digits(digits: str, key: str) -> str:
    """SQL of a digit string permuted within its length; of one digit or more."""
    left = f"(length({digits}) div 2)"
    right = f"(length({digits}) - length({digits}) div 2)"
    size = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
    mixed = _feistel(f"coalesce(try_cast(left({digits}, {left}) as bigint), 0)", f"cast(right({digits}, {right}) as bigint)", size(left), size(right), key)
    return f"element_at(transform(array({mixed}), f -> concat(if({left} = 0, '', lpad(cast(f.a as string), {left}, '0')), lpad(cast(f.b as string), {right}, '0'))), 1)"


def _luhn(digits: str, first_doubled_from_right: int) -> str:
    """SQL of the Luhn sum of a digit string, doubling every second digit from the given place (0: the last)."""
    one = "cast(substr(d, length(d) - i, 1) as int)"
    return (
        f"aggregate(transform(array({digits}), d -> aggregate(sequence(0, length(d) - 1), 0, (t, i) -> t + "
        f"if(i % 2 = {first_doubled_from_right}, {one} * 2 - if({one} > 4, 9, 0), {one}))), 0, (t, x) -> t + x)"
    )


def _laid_out(value: str, digits: str) -> str:
    """SQL of ``value`` with its digits replaced by ``digits`` in order."""
    return (
        f"aggregate(transform(array({digits}), p -> p), '', (z, p) -> aggregate(split({value}, ''), named_struct('o', '', 'i', 1), "
        "(s, c) -> if(c >= '0' AND c <= '9' AND length(c) = 1, named_struct('o', concat(s.o, substr(p, s.i, 1)), 'i', s.i + 1), named_struct('o', concat(s.o, c), 'i', s.i)), s -> s.o))"
    )


def _same_shape(value: str, key: str) -> str:
    """SQL of ``value`` with keyed letters and digits; hexadecimal values stay hexadecimal."""
    byte = f"cast(conv(substr(sha2(concat_ws('|', {key}, i div 32, {value}), 256), (i % 32) * 2 + 1, 2), 16, 10) as int)"
    letters = f"if({value} rlike '^[0-9a-fA-F]+$', 6, 26)"
    char = f"substr({value}, i + 1, 1)"
    return (
        f"array_join(transform(sequence(0, length({value}) - 1), i -> case when {char} rlike '[0-9]' then cast({byte} % 10 as string) "
        f"when {char} rlike '[a-z]' then char(97 + {byte} % {letters}) when {char} rlike '[A-Z]' then char(65 + {byte} % {letters}) else {char} end), '')"
    )


def _bound(name: str, value: str, body: str) -> str:
    """SQL of ``body`` where ``name`` stands for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _is(m: str, pattern: str) -> str:
    return f"{m} rlike {_quoted(f'^(?:{pattern})$')}"


def _digits_from(digits: str, low: int, key: str) -> str:
    """SQL of a string of two digits or more, the first one from ``low`` to 9, permuted among those of its length."""
    left, right = f"(length({digits}) div 2)", f"(length({digits}) - length({digits}) div 2)"
    power = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
    least = f"({low} * {power(f'{left} - 1')})"
    mixed = _feistel(f"cast(left({digits}, {left}) as bigint) - {least}", f"cast(right({digits}, {right}) as bigint)", f"({power(left)} - {least})", power(right), key)
    return _bound("f", mixed, f"concat(cast(f.a + {least} as string), lpad(cast(f.b as string), {right}, '0'))")


def _day(year: str, month: str, day: str) -> str:
    """SQL of the date, null where there is none from 1800 to 2199."""
    text = f"concat_ws('-', {year}, lpad({month}, 2, '0'), lpad({day}, 2, '0'))"
    return _bound("t", f"cast(try_to_timestamp({text}, 'yyyy-MM-dd') as date)", f"if(t >= date'{CYCLE_START}' AND t < date'2200-01-01', t, null)")


def _new_day(day: str, key: str) -> str:
    """SQL of a date permuted among the days of the cycle."""
    a, b = CYCLE_HALVES
    number = f"datediff({day}, date'{CYCLE_START}')"
    return _bound("f", _feistel(f"{number} div {b}", f"{number} % {b}", str(a), str(b), key), f"date_add(date'{CYCLE_START}', cast(f.a * {b} + f.b as int))")


def _year_first(m: str, key: str) -> str:
    field = lambda i: f"split({m}, '[./]')[{i}]"
    sep = f"regexp_extract({m}, '[./]', 0)"
    short = f"{m} rlike '[./][0-9]([./]|$)'"
    out = f"replace(if({short}, date_format(n, 'yyyy-M-d'), date_format(n, 'yyyy-MM-dd')), '-', {sep})"
    return _bound("t", _day(field(0), field(1), field(2)), f"if(t is null, {m}, {_bound('n', _new_day('t', key), out)})")


def _day_month(m: str, key: str) -> str:
    """SQL of a date with day or month first; the number above 12 stays above 12 and at its place."""
    first, second, year = (f"split({m}, '[./-]')[{i}]" for i in range(3))
    sep = f"regexp_extract({m}, '[./-]', 0)"
    number = lambda n: f"if({m} rlike '(^|[./-])[0-9][./-]', cast({n} as string), lpad(cast({n} as string), 2, '0'))"
    a, b = LOW_HALVES
    low = f"(((cast({year} as bigint) - 1800) * 12 + cast({first} as bigint) - 1) * 12 + cast({second} as bigint) - 1)"
    low_text = f"concat_ws({sep}, {number('i div 12 % 12 + 1')}, {number('i % 12 + 1')}, cast(1800 + i div 144 as string))"
    low_new = _bound("i", _bound("f", _feistel(f"{low} div {b}", f"{low} % {b}", str(a), str(b), key), f"f.a * {b} + f.b"), low_text)
    a, b = HIGH_HALVES
    # days above the 12th before a month, counted from the cycle's first one
    before = lambda month: f"(datediff(add_months(date'{CYCLE_START}', cast({month} as int)), date'{CYCLE_START}') - 12 * {month})"
    place = f"({before('((year(t) - 1800) * 12 + month(t) - 1)')} + day(t) - 13)"
    about = f"(i * 4800 div {a * b})"
    month = f"element_at(filter(sequence({about} - 2, {about} + 2), c -> {before('c')} <= i), -1)"
    day = f"(i - {before('u')} + 13)"
    texts = f"if(cast({first} as int) > 12, concat_ws({sep}, {number(day)}, {number('u % 12 + 1')}, cast(1800 + u div 12 as string)), concat_ws({sep}, {number('u % 12 + 1')}, {number(day)}, cast(1800 + u div 12 as string)))"
    mixed = _bound("f", _feistel(f"{place} div {b}", f"{place} % {b}", str(a), str(b), key), f"f.a * {b} + f.b")
    high_new = _bound("i", mixed, _bound("u", month, texts))
    high_day = f"if(cast({first} as int) > 12, {_day(year, second, first)}, {_day(year, first, second)})"
    is_low = f"cast({first} as int) BETWEEN 1 AND 12 AND cast({second} as int) BETWEEN 1 AND 12"
    return f"if({is_low}, if(cast({year} as int) BETWEEN 1800 AND 2199, {low_new}, {m}), {_bound('t', high_day, f'if(t is null, {m}, {high_new})')})"


def _written(m: str, key: str) -> str:
    months = f"array({', '.join(map(_quoted, MONTHS))})"
    name = f"regexp_extract({m}, {_quoted(MONTH)}, 0)"
    day, year = f"regexp_extract({m}, '(?<![0-9])[0-9]{{1,2}}(?![0-9])', 0)", f"regexp_extract({m}, '[0-9]{{4}}', 0)"
    new = f"get({months}, cast((at div 12) * 12 + month(n) - 1 as int))"
    new = f"case when w = upper(w) then upper({new}) when w = initcap(w) then initcap({new}) else {new} end"
    number = f"if({day} like '0%', lpad(cast(day(n) as string), 2, '0'), cast(day(n) as string))"
    ending = "case when day(n) in (1, 21, 31) then 'st' when day(n) in (2, 22) then 'nd' when day(n) in (3, 23) then 'rd' else 'th' end"
    named = f"replace({m}, w, {new})"
    ended = f"case when {m} rlike '[0-9](st|nd|rd|th)' then regexp_replace({named}, '(?<=[0-9])(st|nd|rd|th)', {ending}) when {m} rlike '[0-9]er' then regexp_replace({named}, '(?<=[0-9])er', if(day(n) = 1, 'er', '')) else {named} end"
    out = f"regexp_replace(regexp_replace({ended}, '[0-9]{{4}}', cast(year(n) as string)), '(?<![0-9])[0-9]{{1,2}}(?![0-9])', {number})"
    changed = _bound("t", _day(year, "cast(at % 12 + 1 as string)", day), f"if(t is null, {m}, {_bound('n', _new_day('t', key), out)})")
    return _bound("w", name, _bound("at", f"array_position({months}, lower(w)) - 1", changed))


def _mod97(text: str) -> str:
    """SQL of the remainder of digits and letters (A is 10) read as one number."""
    value = "if(c rlike '[0-9]', ascii(c) - 48, ascii(c) - 55)"
    return f"aggregate(filter(split({text}, ''), c -> c != ''), 0, (s, c) -> (s * if(c rlike '[0-9]', 10, 100) + {value}) % 97)"


def _iban(m: str, key: str) -> str:
    """SQL of an IBAN whose account has its letters shifted by a hash of its digits, then its digits permuted by a key with the new letters."""
    byte = f"cast(conv(substr(sha2(concat_ws('|', {key}, 'iban', i, regexp_replace(x, '[^0-9]', '')), 256), 1, 6), 16, 10) as int)"
    char = "substr(x, i, 1)"
    letters = f"array_join(transform(sequence(1, length(x)), i -> if({char} rlike '[A-Z]', char(65 + (ascii({char}) - 65 + {byte}) % 26), {char})), '')"
    permuted = _digits("regexp_replace(y, '[^0-9]', '')", f"concat_ws('|', {key}, 'iban', regexp_replace(y, '[0-9]', ''))")
    account = _bound("x", "substr(v, 5)", _bound("y", letters, _laid_out("y", permuted)))
    checked = _bound("z", account, f"concat(left(v, 2), lpad(cast(98 - {_mod97("concat(z, left(v, 2), '00')")} as string), 2, '0'), z)")
    # spaces come back at their places
    spaced = f"aggregate(split({m}, ''), named_struct('o', '', 'i', 1), (s, c) -> if(c = ' ' OR c = '', named_struct('o', concat(s.o, c), 'i', s.i), named_struct('o', concat(s.o, substr(q, s.i, 1)), 'i', s.i + 1)), s -> s.o)"
    valid = f"{_mod97('concat(substr(v, 5), left(v, 4))')} = 1 AND substr(v, 5) rlike '[0-9]'"
    return _bound("v", f"replace({m}, ' ', '')", f"if({valid}, {_bound('q', checked, spaced)}, {m})")


def _ip6(m: str, key: str) -> str:
    """SQL of an IPv6 address, whose halves of 64 bits meet in rounds of exclusive or."""
    groups = lambda text: f"filter(split({text}, ':'), g -> g != '')"
    head, tail = groups(f"split({m}, '::')[0]"), groups(f"get(split({m}, '::'), 1)")
    full = f"concat({head}, array_repeat('0', 8 - size(h) - size(l)), l)"
    full = f"array_join(transform(if(instr({m}, '::') > 0, {full}, h), g -> lpad(lower(g), 4, '0')), '')"
    half = lambda x, y, at: f"lpad(lower(hex(cast(conv(substr({x}, {at}, 8), 16, 10) as bigint) ^ cast(conv(substr({y}, {at}, 8), 16, 10) as bigint))), 8, '0')"
    mix = lambda a, b: _bound("d", f"sha2(concat_ws('|', {key}, 'ip6', r, {b}), 256)", f"concat({half(a, 'd', 1)}, {half(a, 'd', 9)})")
    rounds = (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', left(x, 16), 'b', right(x, 16)), (s, r) -> if(r % 2 = 1, "
        f"named_struct('a', {mix('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {mix('s.b', 's.a')})), s -> concat(s.a, s.b))"
    )
    out = "array_join(transform(sequence(0, 7), i -> regexp_replace(substr(z, i * 4 + 1, 4), '^0{1,3}', '')), ':')"
    new = _bound("x", full, _bound("z", rounds, out))
    valid = f"{m} rlike '[0-9]' AND (size(h) = 8 OR instr({m}, '::') > 0) AND size(h) + size(l) <= if(instr({m}, '::') > 0, 7, 8)"
    return _bound("h", head, _bound("l", f"coalesce({tail}, cast(array() as array<string>))", f"if({valid}, {new}, {m})"))


def _pseudonym(m: str, key: str) -> str:
    """SQL of the replacement of one match ``m``; ``m`` itself where it fails its test."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    octet = lambda i: f"cast(split({m}, '[.]')[{i}] as bigint)"
    ip = _feistel(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536", key)
    ip = f"element_at(transform(array({ip}), f -> concat_ws('.', f.a div 256, f.a % 256, f.b div 256, f.b % 256)), 1)"
    ip_valid = " AND ".join(f"{octet(i)} < 256" for i in range(4))
    day = f"datediff(cast(try_to_timestamp({m}, 'yyyy-MM-dd') as date), date'{CYCLE_START}')"
    a, b = CYCLE_HALVES
    date = f"element_at(transform(array({_feistel(f'{day} div {b}', f'{day} % {b}', str(a), str(b), key)}), f -> cast(date_add(date'{CYCLE_START}', cast(f.a * {b} + f.b as int)) as string)), 1)"
    area, group, serial = (f"cast(split({m}, '-')[{i}] as bigint)" for i in range(3))
    ssn_a = f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1"
    ssn = _feistel(ssn_a, f"{serial} - 1", str(898 * 99), "9999", key)
    ssn = (
        f"element_at(transform(array({ssn}), f -> concat_ws('-', lpad(cast(f.a div 99 + if(f.a div 99 > 664, 2, 1) as string), 3, '0'), "
        "lpad(cast(f.a % 99 + 1 as string), 2, '0'), lpad(cast(f.b + 1 as string), 4, '0'))), 1)"
    )
    body = _digits(f"left({digits}, length({digits}) - 1)", key)
    card = f"element_at(transform(array({body}), n -> concat(n, cast((10 - {_luhn('n', 0)} % 10) % 10 as string))), 1)"
    code = f"regexp_extract({m}, '^[+][0-9]+([ .-]?[(]0[)])?', 0)"
    own = lambda kind: f"concat({key}, '|{kind}')"
    national = [
        f"when {_is(m, pattern)} then {_laid_out(m, f"concat('0', {_digits_from(f'substr({digits}, 2)', low, own('national'))})" if low == 1 else _digits_from(digits, low, own('national')))} "
        for low, pattern in NATIONAL.items()
    ]
    rest = f"substr({m}, length({code}) + 1)"
    phone = f"concat({code}, {_laid_out(rest, _digits(f"regexp_replace({rest}, '[^0-9]', '')", key))})"
    compact = _digits(f"substr({digits}, 3)", key)
    secret = f"regexp_extract({m}, '^(.*[:=][ ]*[\"\\\\x27]?)?(.*)$', 1)"
    secret_rest = f"substr({m}, length({secret}) + 1)"
    return (
        f"case when instr({m}, '@') > 0 then concat({_same_shape(f"left({m}, length({m}) - instr(reverse({m}), '.'))", key)}, right({m}, instr(reverse({m}), '.'))) "
        f"when {_is(m, IBAN)} then {_iban(m, key)} when {_is(m, IP6)} then {_ip6(m, key)} when {_is(m, WRITTEN)} then {_written(m, key)} "
        f"when {_is(m, YEAR_FIRST)} then {_year_first(m, key)} when {_is(m, DAY_MONTH)} then {_day_month(m, own('day-month'))} "
        f"when {m} rlike '^[A-Za-z]' then concat({secret}, {_same_shape(secret_rest, key)}) "
        f"when {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then if(cast(try_to_timestamp({m}, 'yyyy-MM-dd') as date) >= date'{CYCLE_START}' AND cast(try_to_timestamp({m}, 'yyyy-MM-dd') as date) < date'2200-01-01', {date}, {m}) "
        f"when {m} rlike '^[0-9]+([.][0-9]+){{3}}$' then if({ip_valid}, {ip}, {m}) "
        f"when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if({area} BETWEEN 1 AND 899 AND {area} != 666 AND {group} > 0 AND {serial} > 0, {ssn}, {m}) "
        f"when {m} like '+%' then if({rest} rlike '[0-9]', {phone}, concat('+', left({digits}, 2), {compact})) "
        f"when {_is(m, CARD)} AND {_luhn(digits, 1)} % 10 = 0 then {_laid_out(m, card)} {''.join(national)}else {m} end"
    )


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text", found: str = "n_private") -> DataFrame:
    """``docs`` with the private values of ``text`` replaced, and their number as ``found``."""
    pattern, secret = _quoted(PATTERN), _quoted(key)
    matches, pieces = free_name(docs, "matches"), free_name(docs, "pieces")
    replaced = f"transform(`{matches}`, m -> {_pseudonym('m', secret)})"
    some = F.col(text).rlike("[0-9@]|(?i:token|password|passwd|pwd|secret|key)")
    extracted = docs.withColumn(matches, F.when(some, F.expr(f"regexp_extract_all(`{text}`, {pattern}, 0)")))
    pairs = f"transform(split(`{text}`, {pattern}, -1), (p, i) -> concat(p, coalesce(get(`{pieces}`, i), '')))"
    swapped = extracted.withColumn(pieces, F.expr(replaced))
    values = F.expr(f"size(filter(zip_with(`{matches}`, `{pieces}`, (m, p) -> m != p), x -> x))")
    out = {text: F.when(F.size(matches) > 0, F.expr(f"array_join({pairs}, '')")).otherwise(F.col(text)), found: F.coalesce(F.when(F.size(matches) > 0, values), F.lit(0)).cast("bigint")}
    return swapped.withColumns(out).select(*dict.fromkeys([*docs.columns, found]))


def private_values(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_private and the pseudonymised text of every row."""
    return pseudonymise(docs.select("doc_id", "text"), key)
