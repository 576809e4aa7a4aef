"""Surrogates for personal data, in DataFrame and SQL functions only.

One pattern finds e-mail addresses, telephone numbers, network addresses, card, social-security and account numbers,
access keys, values of passwords and tokens, dates of birth, and names after forms of address and titles. Each becomes a
value of its kind, drawn by a keyed SHA-256 of the entity's canonical form: letters stay letters of their case, digits
digits, punctuation stays, a card number that passes its check digit passes again, a telephone number keeps its country
code, a name keeps gender and script, a date its way of writing. Equal entities, however written, get equal surrogates (a
name's parts are entities of their own, so "Mr. John Hill", "Dr. HILL" and "Mr. Hill" stay linked).

Collision checks: over the distinct entities, no two may get the same surrogate and none may get a form that occurs;
those that do are drawn again with the next attempt number until there are none. (Dates are all moved by one keyed number
of days, which keeps them apart; initials are letters and can't be kept apart.) Texts are then rewritten in place: an
attempt number other than 0 is looked up, in a literal of up to SENT redrawn entities, or beyond in a map that each text
with such entities gets by a join on the text's digest.

Scale: what is shuffled are the distinct entities (aggregated before the shuffle, so one address in a third of the
documents is one row for each task). Texts are shuffled only where more than SENT entities are drawn again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

KEY = "kvloom"
SENT = 10_000
_BUCKETS = 1024
MAX_ATTEMPTS = 24

MALE = r"Mr|Herr|Herrn|Monsieur|Señor|Sr|Don|Господин|г-н|Κύριος"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Señorita|Sra|Doña|Госпожа|г-жа|Κυρία"
#: Titles that say nothing of gender; the first name's ending then decides.
NEUTRAL = r"Dr|Prof|Professor|Doctor|Доктор|Профессор"
_FEMININE = r"(?i)(?:a|e|я|а|α|η|ά|ή)$"
_PART = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+"
_TITLES = rf"(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.? )+"
_DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What stands before a secret: the word, with any prefix that ends in a mark, and its sign, in any case.
_KEYWORD = r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|token|secret|api_key|apikey)[\"']?\s{0,2}[=:]\s{0,2}"
#: A value of fewer letters and digits (asterisks, say) has no surrogate of its own.
_SOLID = r"(?=(?:[^\s\p{Ll}\p{Lu}0-9]*+[\p{Ll}\p{Lu}0-9]){4})"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}\-]{1,63}+\.){1,8}\p{L}{2,24}",
    "secret": rf"(?:(?<=[=:\"'])|(?<=[=:]\s{{1,2}}))(?:(?<={_KEYWORD}\"){_SOLID}(?:(?:\\.|[^\"\\\r\n]){{6,}}+(?=\")|[^\s\"]{{6,}})|(?<={_KEYWORD}'){_SOLID}(?:(?:\\.|[^'\\\r\n]){{6,}}+(?=')|[^\s']{{6,}})|(?<={_KEYWORD})(?![\"'\s]){_SOLID}\S{{6,}})",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9\-])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])",
    "card": r"(?<![0-9A-Za-z\-])(?:[0-9][ \-]?){12,18}[0-9](?![0-9A-Za-z])",
    "birth": rf"(?<=(?i:born|birth|dob|geboren|geburtsdatum|nacid[oa]|nacimiento|née?|naissance|родился|родилась|рождения)[ :(]{{1,3}}(?:on |am |le |el )?){_DATE}(?![0-9])",
    "name": rf"(?<!\p{{L}}){_TITLES}(?:\p{{Lu}}\. ?){{0,2}}{_PART}(?:[ \-]{_PART}){{0,2}}",
}
_P = {k: f"(?:{p})" for k, p in PATTERNS.items()}
#: Each branch starts with a look at one character, which settles most places in a text at once.
_OTHERS = rf"(?=[0-9+(])(?:{_P['birth']}|{_P['ip']}|{_P['ssn']}|{_P['phone']}|{_P['card']})|(?=[A-Z])(?:{_P['key']}|{_P['iban']})|(?=[MHFSDPГгΚДП]){_P['name']}"
_WITHOUT_MAIL = f"{_P['secret']}|{_OTHERS}"
PATTERN = f"{_P['secret']}|{_P['email']}|{_OTHERS}"

#: Names are made of syllables and an ending: 16 * 16 * 8 first names and 16 ** 3 * 8 surnames at first, 16 times as many with each attempt.
SYLLABLES = {"latin": "bar den fol gan hel kir lam mor nes pol rin sal tor val wen zor", "cyrillic": "бар ден фол ган хел кир лам мор нес пол рин сал тор вал вен зор", "greek": "βαρ δεν φολ γαν κελ λαμ μορ νες πολ ριν σαλ τορ βελ δαν κιρ ζορ"}
FIRST = {
    "m:latin": "o us an el ard win rich mund",
    "f:latin": "a ia ina ela etta wina linda ara",
    "m:cyrillic": "ий ан ей ил ор ин ад им",
    "f:cyrillic": "ия ана ея ила ора ина ада има",
    "m:greek": "ος ης ας ιος ανης ινος ωνας ιας",
    "f:greek": "α η ια ινα ανη ουλα ιτσα ωνη",
}
LAST = {"latin": "son mann er ez ini berg ard ell", "cyrillic": "ов ев ин ский цкий ых их ко", "greek": "ης ος ας ιδης ακης οπουλος ελης ινος"}
_LAST_WOMAN = "ова ева ина ская цкая ова ева ина"


def _text(s: str) -> str:
    """s as an SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def kind_of(m: str) -> str:
    tests = [("email", f"{m} rlike {_text('^(?:' + PATTERNS['email'] + ')$')}"), ("name", f"{m} rlike {_text('^(?:' + PATTERNS['name'] + ')$')}")]
    tests += [("birth", f"{m} rlike {_text('^' + _DATE + '$')}")]
    tests += [(k, f"{m} rlike {_text('^(?:' + PATTERNS[k] + ')$')}") for k in ("key", "iban", "ip", "ssn", "phone", "card")]
    return "case " + " ".join(f"when {t} then '{k}'" for k, t in tests) + " else 'secret' end"


def canonical(kind: str, v: str) -> str:
    """One form for all writings of an entity that isn't a name."""
    return f"case when {kind} = 'email' then lower({v}) when {kind} = 'phone' then right({_digits(v)}, 10) when {kind} in ('card', 'ssn') then {_digits(v)} when {kind} = 'iban' then replace({v}, ' ', '') else {v} end"


def script_of(p: str) -> str:
    return f"case when {p} rlike '^\\\\p{{IsCyrillic}}' then 'cyrillic' when {p} rlike '^\\\\p{{IsGreek}}' then 'greek' else 'latin' end"


def titles_of(m: str) -> str:
    """The forms of address and titles before a name, with the blank after them."""
    return f"regexp_extract({m}, {_text('^' + _TITLES)}, 0)"


def tokens(m: str, kind: str) -> str:
    """array<struct<kind, canon>> of a match: a name's parts, or the match itself."""
    titles = titles_of(m)
    parts = f"split(substr({m}, length({titles}) + 1), '[ \\\\-]')"
    man, woman = (_text(rf"(?:^| )(?:{x})\.? ") for x in (MALE, FEMALE))
    gender = f"case when {titles} rlike {woman} then 'f' when {titles} rlike {man} then 'm' when p rlike {_text(_FEMININE)} then 'f' else 'm' end"
    initial = _text(r"^\p{Lu}\.$")
    # a surname is one entity for both genders
    part = f"case when p rlike {initial} then 'initial' when i = size(ps) - 1 then concat('last:', {script_of('p')}) else concat('first:', {gender}, ':', {script_of('p')}) end"
    name = _let(parts, "ps", f"transform(ps, (p, i) -> named_struct('kind', {part}, 'canon', replace(lower(p), '’', chr(39))))")
    return f"if({kind} = 'name', {name}, array(named_struct('kind', {kind}, 'canon', {canonical(kind, m)})))"


def _digest(key: str, kind: str, canon: str, attempt: str) -> str:
    base = f"concat_ws('|', {_text(key)}, {kind}, cast({attempt} as string), {canon})"
    return f"concat(sha2(concat({base}, '|0'), 256), sha2(concat({base}, '|1'), 256))"


def _draw(h: str, i: str, n: str) -> str:
    """A number below n from the digest, for place i."""
    return f"cast(pmod(cast(conv(substr({h}, 1 + pmod(({i}) * 5, 122), 6), 16, 10) as bigint), {n}) as int)"


def _chars(v: str, h: str, hexes: str = "false") -> str:
    """v with letters and digits drawn anew, each of its class; hexadecimal letters stay so where hexes holds."""
    letter = f"substr('abcdefghijklmnopqrstuvwxyz', 1 + {_draw(h, 'i', f'if({hexes}, 6, 26)')}, 1)"
    return f"array_join(transform(split({v}, ''), (c, i) -> case when c rlike '^[0-9]$' then cast({_draw(h, 'i', '10')} as string) when c rlike '^\\\\p{{Ll}}$' then {letter} when c rlike '^\\\\p{{Lu}}$' then upper({letter}) else c end), '')"


def _from_right(v: str, new: str) -> str:
    """v with its digits replaced by those of new, the last by the last; digits beyond new stay."""
    j = f"length({_digits(f'substr({v}, i + 1)')})"
    return f"array_join(transform(split({v}, ''), (c, i) -> if(c rlike '^[0-9]$' and {j} <= length({new}), substr({new}, length({new}) - {j} + 1, 1), c)), '')"


def _phone(v: str, canon: str, h: str, attempt: str) -> str:
    first = f"cast(2 + {_draw(h, '0', '8')} as string)"
    middle = f"if(substr({canon}, 4, 3) = '555' and {attempt} < 4, '555', concat({_draw(h, '3', '8')} + 2, {_draw(h, '4', '10')}, {_draw(h, '5', '10')}))"
    rest = ", ".join(_draw(h, str(i), "10") for i in (6, 7, 8, 9))
    whole = f"concat({first}, {_draw(h, '1', '10')}, {_draw(h, '2', '10')}, {middle}, {rest})"
    return _let(f"right({whole}, length({canon}))", "fresh", _from_right(v, "fresh"))


def _card(v: str, canon: str, h: str) -> str:
    body = f"concat(left({canon}, 1), array_join(transform(sequence(1, length({canon}) - 2), k -> cast({_draw(h, 'k', '10')} as string)), ''))"
    term = "cast(substr(b, length(b) - k + 1, 1) as int) * if(k % 2 = 1, 2, 1)"
    total = f"aggregate(sequence(1, length(b)), 0, (a, k) -> a + ({term}) - if(({term}) > 9, 9, 0))"
    check = f"if(luhn_check({canon}), cast(pmod(10 - pmod({total}, 10), 10) as string), cast({_draw(h, '20', '10')} as string))"
    return _let(body, "b", _let(f"concat(b, {check})", "fresh", _from_right(v, "fresh")))


def _email(v: str, key: str, h: str) -> str:
    labels = f"split(split({v}, '@')[1], '[.]')"
    hosts = f"slice({labels}, 1, greatest(size({labels}) - 2, 0))"
    host = _let(_digest(key, "'host'", f"lower(split({v}, '@')[1])", "0"), "hh", f"array_join(concat(transform({hosts}, x -> {_chars('x', 'hh')}), array('example', {labels}[size({labels}) - 1])), '.')")
    return f"concat({_chars(f'split({v}, chr(64))[0]', h)}, '@', {host})"


def _spread(v: str, fresh: str) -> str:
    """v with its characters but for blanks replaced by those of fresh, in order."""
    return f"array_join(transform(split({v}, ''), (c, i) -> if(c = ' ', c, substr({fresh}, length(replace(substr({v}, 1, i + 1), ' ', '')), 1))), '')"


def _name(kind: str, v: str, h: str, attempt: str) -> str:
    """A part of a name by its kind (first:gender:script or last:script), longer with every attempt; v's case is kept."""
    words = lambda listed: "array(" + ", ".join(map(_text, listed.split())) + ")"
    made = lambda script, n: f"array_join(transform(sequence(1, {n} + {attempt}), k -> {words(SYLLABLES[script])}[{_draw(h, 'k', '16')}]), '')"
    ending = lambda listed: f"{words(listed)}[{_draw(h, '0', '8')}]"
    cases = [f"when {kind} = 'initial' then concat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + {_draw(h, '0', '26')}, 1), '.')"]
    cases += [f"when {kind} = 'first:{k}' then concat({made(k[2:], 2)}, {ending(listed)})" for k, listed in FIRST.items()]
    for script, listed in LAST.items():
        last = f"if({v} rlike {_text('(?i)а$')}, {ending(_LAST_WOMAN)}, {ending(listed)})" if script == "cyrillic" else ending(listed)
        cases.append(f"when {kind} = 'last:{script}' then concat({made(script, 3)}, {last})")
    mark = _text(r"^\p{L}['’]")
    shaped = f"case when {kind} = 'initial' then x when length({v}) > 1 and {v} = upper({v}) then upper(x) else initcap(x) end"
    return _let("case " + " ".join(cases) + f" else {v} end", "x", f"if({v} rlike {mark}, concat(left({v}, 2), {shaped}), {shaped})")


def _birth(v: str, key: str) -> str:
    """The date moved by a number of days that the key alone decides, written as v; an impossible date gets other digits."""
    days = f"cast(200 + pmod(conv(substr(sha2(concat({_text(key)}, '|birth'), 256), 1, 7), 16, 10), 3000) as int)"
    forms = (("-", "yyyy-MM-dd"), (".", "d.M.yyyy"), ("/", "d/M/yyyy"))
    moved = "coalesce(" + ", ".join(f"date_format(date_sub(cast(try_to_timestamp({v}, '{f}') as date), {days}), if({v} rlike '^[0-9]{{2}}.[0-9]{{2}}.[0-9]{{4}}$', '{f.replace('d.M', 'dd.MM').replace('d/M', 'dd/MM')}', '{f}'))" for _, f in forms)
    return f"{moved}, translate({v}, '0123456789', '3456789012'))"


def surrogate(key: str, kind: str, canon: str, v: str, attempt: str) -> str:
    """SQL for the surrogate of writing v of the entity (kind, canon)."""
    ip = "concat_ws('.', " + ", ".join(f"cast({'11 + ' if i == 0 else '1 + '}{_draw('h', str(i), '89' if i == 0 else '254')} as string)" for i in range(4)) + ")"
    secret = _chars(v, "h", f"{canon} rlike '^[0-9a-f]+$'")
    keyed = f"concat(left({v}, 4), {_chars(f'substr({v}, 5)', 'h')})"
    ssn = f"concat(lpad(cast(1 + {_draw('h', '0', '665')} as string), 3, '0'), '-', lpad(cast(1 + {_draw('h', '1', '99')} as string), 2, '0'), '-', lpad(cast(1 + {_draw('h', '2', '9999')} as string), 4, '0'))"
    body = (
        f"case when {kind} = 'email' then {_email(v, key, 'h')} when {kind} = 'phone' then {_phone(v, canon, 'h', attempt)} when {kind} = 'card' then {_card(v, canon, 'h')} "
        f"when {kind} = 'ip' then {ip} when {kind} = 'ssn' then if({v} like '%-%', {ssn}, {_digits(ssn)}) when {kind} = 'key' then {keyed} when {kind} = 'iban' then {_let(f"concat(left({canon}, 2), {_chars(f'substr({canon}, 3)', 'h')})", 'fresh', _spread(v, 'fresh'))} when {kind} = 'birth' then {_birth(v, key)} "
        f"when {kind} = 'secret' then {secret} else {_name(kind, v, 'h', attempt)} end"
    )
    return _let(_digest(key, kind, canon, attempt), "h", body)


def matches(text: str) -> str:
    """SQL for the array of all matches in a text; the branch for mail runs only where there is an @."""
    return f"if(instr({text}, '@') > 0, regexp_extract_all({text}, {_text(PATTERN)}, 0), regexp_extract_all({text}, {_text(_WITHOUT_MAIL)}, 0))"


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, canon: the distinct entities of all texts."""
    found = docs.select(F.col(text).cast("string").alias("t")).select(F.explode(F.expr(matches("t"))).alias("m")).withColumn("k", F.expr(kind_of("m")))
    return found.select(F.explode(F.expr(tokens("m", "k"))).alias("t")).select("t.kind", "t.canon").distinct()


def redrawn(found: DataFrame, key: str = KEY) -> DataFrame:
    """name (kind|canon), attempt: the entities that need an attempt above 0 for all to have surrogates of their own."""
    found = cut(found.where("kind not in ('initial', 'birth')"))
    state = found.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ATTEMPTS):
        drawn = state.withColumn("fresh", F.expr(canonical_of_surrogate(key)))
        taken = found.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
        known = drawn.join(taken, (F.col("kind") == F.col("k")) & (F.col("fresh") == F.col("c")), "left_semi").select("kind", "canon")
        again = drawn.withColumn("n", F.row_number().over(Window.partitionBy("kind", "fresh").orderBy("attempt", "canon"))).where("n > 1").select("kind", "canon")
        bad = cut(known.union(again).distinct())
        if bad.isEmpty():
            return state.where("attempt > 0").select(F.concat_ws("|", "kind", "canon").alias("name"), "attempt")
        bad = bad.withColumn("bad", F.lit(1))
        state = cut(state.join(bad, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("bad", F.lit(0))).alias("attempt")))
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def _listed(attempts: DataFrame) -> str:
    """SQL for the attempt of entity t, of a literal: maps in buckets by a hash of the name, so that none is long."""
    buckets: list[dict] = [{} for _ in range(_BUCKETS)]
    for r in attempts.select("name", "attempt", F.pmod(F.xxhash64("name"), F.lit(_BUCKETS)).alias("b")).collect():  # at most SENT
        buckets[r["b"]][r["name"]] = r["attempt"]
    name = "concat(t.kind, '|', t.canon)"
    return f"coalesce(from_json({_text(json.dumps(buckets))}, 'array<map<string,int>>')[cast(pmod(xxhash64({name}), {_BUCKETS}) as int)][{name}], 0)"


def _by_text(given: DataFrame, attempts: DataFrame) -> DataFrame:
    """given with __attempts: for texts with redrawn entities their attempts by name. Texts are known by their SHA-256."""
    marked = given.withColumn("__sha", F.sha2("text", 256))
    own = marked.select("__sha", F.explode(F.expr(matches("text"))).alias("m")).withColumn("k", F.expr(kind_of("m"))).select("__sha", F.explode(F.expr(tokens("m", "k"))).alias("t"))
    own = own.select("__sha", F.concat_ws("|", "t.kind", "t.canon").alias("name")).distinct().join(attempts, "name")
    maps = own.groupBy("__sha").agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("__attempts"))
    return marked.join(maps, "__sha", "left")


def canonical_of_surrogate(key: str) -> str:
    """Of columns kind, canon, attempt: the canonical form of the surrogate."""
    fresh = surrogate(key, "kind", "canon", "canon", "attempt")
    return _let(fresh, "s", f"if(kind like 'first:%' or kind like 'last:%', replace(lower(s), '’', chr(39)), {canonical('kind', 's')})")


def replaced(text: str, found: str, key: str, lookup: str) -> Column:
    """The text column with surrogates for its matches, the array column found; lookup is SQL for the attempt of entity t."""
    one = _let(lookup, "attempt", surrogate(key, "t.kind", "t.canon", "{v}", "attempt"))
    titles = titles_of("m")
    # a name: forms of address, then each part with the blank or hyphen before it
    gap = _text(r"^[ \-]")
    part = one.replace("{v}", f"regexp_replace(z.`1`, {gap}, '')")
    part = _let("z.k_tokens", "t", f"concat(regexp_extract(z.`1`, {gap}, 0), {part})")
    rest = f"regexp_extract_all(concat(' ', substr(m, length({titles}) + 1)), {_text('[ -][^ -]+')}, 0)"
    titled = f"concat({titles}, substr(array_join(transform(arrays_zip(k_tokens, {rest}), z -> {part}), ''), 2))"
    single = _let("k_tokens[0]", "t", one.replace("{v}", "m"))
    each = _let(kind_of("m"), "k", _let(tokens("m", "k"), "k_tokens", f"if(k = 'name', {titled}, {single})"))
    return F.expr(f"if(size({found}) > 0, array_join(flatten(transform(arrays_zip(split({text}, {_text(PATTERN)}, -1), transform({found}, m -> {each})), p -> array(p.`0`, coalesce(p.`1`, '')))), ''), {text})")


def pseudonymised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str = KEY, sent: int = SENT) -> DataFrame:
    """doc_id, text with surrogates, n_entities for each row.

    A null text stays null and an empty one empty, with no entities; equal rows give equal rows; other columns are not
    looked at. No rows, no rows.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    attempts = cut(redrawn(entities(given), key))
    n = attempts.count()
    if n > sent:
        given, lookup = _by_text(given, attempts), "coalesce(__attempts[concat(t.kind, '|', t.canon)], 0)"
    else:
        lookup = _listed(attempts) if n else "0"
    marked = given.withColumn("found", F.expr(matches("text")))
    return marked.select("doc_id", replaced("text", "found", key, lookup).alias("text"), F.greatest(F.size("found"), F.lit(0)).alias("n_entities"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"))
