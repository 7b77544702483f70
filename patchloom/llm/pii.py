"""Personal data replaced by keyed surrogates.

Entities are found by patterns: e-mail addresses, telephone, card, account and
social security numbers, IP addresses, keys and passwords, and names after a
title.  Each is replaced by a surrogate that a keyed hash of its kind and text
makes: the same entity gets the same surrogate in every document, and the
surrogate keeps the kind, length, punctuation, letter case and script; a card
number with a right check digit gets one with a right check digit, a name's
endings follow the title's gender and the script.

Distinct entities keep distinct surrogates: all distinct entities meet in one
table, and as long as two of a kind share a surrogate, or a surrogate is itself
an entity of the corpus, those take the hash's next number.  Every ``WIDER``
numbers the surrogate grows by one character (a name's words by one syllable),
so that a kind with more entities than surrogates of its form ends, too.  Only
such entities are joined back to their documents; all other surrogates are made
in the row.

Letters that are neither Latin, Cyrillic nor Greek become Latin ones.  A secret
without any letter or digit gets letters throughout.

Null texts stay null.  Texts without an entity stay as they are.  Rows are
treated one by one, repeated ones alike; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.text import sql_text
from patchloom.llm.shared import cut, private, saved
from patchloom.operators.parse import fixed_columns

#: Titles by gender.
MALE = ("Mr.", "Mr", "Herr", "Señor", "Sr.", "Monsieur", "M.", "господин", "Господин")
FEMALE = ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Señora", "Sra.", "Madame", "Mme", "госпожа", "Госпожа")
NEUTRAL = ("Dr.", "Dr", "Prof.")
#: Syllables and endings of made-up names, by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo za ze".split(),
    "cyrillic": "ба бе би бо да де ди до га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви во за зе".split(),
    "greek": "βα βε βι βο δα δε δι δο γα γε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φε φι φο ζα ζε".split(),
}
#: Letters by script, in lower case, beside a to z.
ALPHABETS = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: A surrogate that is still taken grows after so many tries.
WIDER = 16
ENDINGS = {
    ("latin", "male"): "n", ("latin", "female"): "a", ("latin", "any"): "s",
    ("cyrillic", "male"): "ов", ("cyrillic", "female"): "ова", ("cyrillic", "any"): "ко",
    ("greek", "male"): "ος", ("greek", "female"): "α", ("greek", "any"): "ης",
}


def _any_of(words: tuple[str, ...]) -> str:
    ordered = sorted(words, key=len, reverse=True)
    return "|".join(w.replace(".", r"\.") for w in ordered)


NAME = r"\p{Lu}\p{L}+(?:[ -]\p{Lu}\p{L}+){0,2}"
TITLES = _any_of(MALE + FEMALE + NEUTRAL)
#: Kinds and their patterns, the first that matches a text names its kind.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{16}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4})(?!\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "key": r"(?<!\w)(?:AKIA[0-9A-Z]{12,}|gh[pousr]_\w{20,}|sk-\w{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)",
    "secret": r"(?<=(?:password|passwd|secret|token|api_key|apikey)(?: = |: |=|:)[\"']?)[^\s\"']{6,}",
    "name": rf"(?<!\p{{L}})(?:{TITLES}) {NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these hold no entity and are not searched further.
HINT = rf"[0-9@]|(?:password|passwd|secret|token|api_?key)[ =:]|(?:{TITLES}) \p{{Lu}}"


def _kind(value: str) -> str:
    whens = [f"WHEN {value} RLIKE {sql_text(f'^(?:{p})$')} THEN '{kind}'" for kind, p in PATTERNS.items() if kind != "secret"]
    return f"CASE {' '.join(whens)} ELSE 'secret' END"


def _number(stream: str, at: str) -> str:
    """SQL: a number from 0 to 255 from the hexadecimal ``stream``."""
    return f"cast(conv(substr({stream}, 1 + 2 * pmod({at}, 64), 2), 16, 10) AS int)"


def _like(value: str, stream: str, fixed: str = "0") -> str:
    """SQL: ``value`` with other digits and letters of the same case and script, but for its first ``fixed`` characters.

    Letters of scripts without an alphabet become Latin; where there is no letter or digit, all characters become letters.
    """
    n = _number("s", "i")
    others = ""
    for script, letters in ALPHABETS.items():
        pick = f"substr('{{}}', 1 + {n} % {len(letters)}, 1)"
        for case, own in (("Lu", letters.upper()), ("L", letters)):
            others += rf" WHEN c RLIKE '[\\p{{Is{script}}}&&\\p{{{case}}}]' THEN {pick.format(own)}"
    return rf"""array_join(transform(split({value}, ''), (c, i) -> CASE
        WHEN i < {fixed} THEN c
        WHEN c BETWEEN '0' AND '9' THEN cast({n} % 10 AS string)
        WHEN c BETWEEN 'a' AND 'z' THEN char(97 + {n} % 26)
        WHEN c BETWEEN 'A' AND 'Z' THEN char(65 + {n} % 26)
        WHEN c >= chr(128) OR {value} NOT RLIKE '[\\p{{L}}\\p{{N}}]' THEN CASE{others}
            WHEN c RLIKE '\\p{{Lu}}' THEN char(65 + {n} % 26)
            WHEN c RLIKE '\\p{{N}}' THEN cast({n} % 10 AS string)
            WHEN c RLIKE '\\p{{L}}' OR {value} NOT RLIKE '[\\p{{L}}\\p{{N}}]' THEN char(97 + {n} % 26)
            ELSE c END
        ELSE c END), '')""".replace("substr(s,", f"substr({stream},")


def _hex_like(value: str, stream: str) -> str:
    n = _number(stream, "i")
    return f"""array_join(transform(split({value}, ''), (c, i) -> CASE
        WHEN c BETWEEN '0' AND '9' OR c BETWEEN 'a' AND 'f' THEN substr('0123456789abcdef', 1 + {n} % 16, 1)
        WHEN c BETWEEN 'A' AND 'F' THEN substr('0123456789ABCDEF', 1 + {n} % 16, 1) ELSE c END), '')"""


def _luhn(digits: str) -> str:
    """SQL: the check sum of 16 digits; a right number has 0."""
    doubled = "CASE WHEN i % 2 = 0 THEN 2 * cast(d AS int) - CASE WHEN d > '4' THEN 9 ELSE 0 END ELSE cast(d AS int) END"
    return f"aggregate(transform(split({digits}, ''), (d, i) -> {doubled}), 0, (a, x) -> a + x) % 10"


def _card(value: str, stream: str) -> str:
    digits = f"regexp_replace({value}, '[ -]', '')"
    made = _like(value, stream)
    front = f"substr({made}, 1, length({made}) - 1)"
    short = f"concat(regexp_replace({front}, '[ -]', ''), '0')"
    return f"CASE WHEN {_luhn(digits)} = 0 THEN concat({front}, cast((10 - {_luhn(short)}) % 10 AS string)) ELSE {made} END"


def _name(value: str, key: str, nonce: str) -> str:
    """SQL: title kept, each word of the name made of syllables of its script, with an ending of the title's gender.

    A word's syllables come from a keyed hash of the word alone, so a surname
    has one stem after every title and in every document.
    """
    stream = "hw"

    def word(script: str) -> str:
        parts = SYLLABLES[script]
        pool = f"array({', '.join(map(sql_text, parts))})"
        picks = [f"get({pool}, ({_number(stream, str(k))} + 256 * {_number(stream, str(31 + k))}) % {len(parts)})" for k in range(3)]
        gender = " ".join(
            f"WHEN title IN ({', '.join(map(sql_text, names))}) THEN {sql_text(ENDINGS[script, g])}"
            for g, names in (("male", MALE), ("female", FEMALE))
        )
        at = _number(stream, "7 + 17 * e")
        # array_repeat, as a sequence can't be empty
        more = f"array_join(transform(array_repeat(0, cast({nonce} div {WIDER} AS int)), (z, e) -> get({pool}, {at} % {len(parts)})), '')"
        made = f"initcap(concat({', '.join(picks)}, {more}, CASE {gender} ELSE {sql_text(ENDINGS[script, 'any'])} END))"
        seed = f"sha2(concat_ws('|', {sql_text(key)}, 'name', w, {nonce}), 512)"
        return f"element_at(transform(array({seed}), hw -> {made}), 1)"

    made = rf"""CASE WHEN w RLIKE '^[ -]$' THEN w WHEN w RLIKE '\\p{{IsCyrillic}}' THEN {word('cyrillic')}
        WHEN w RLIKE '\\p{{IsGreek}}' THEN {word('greek')} ELSE {word('latin')} END"""
    title = f"substring_index({value}, ' ', 1)"
    rest = f"split(substr({value}, length({title}) + 2), '(?<=[ -])|(?=[ -])')"
    # the title is bound to a name for the inner expression
    return f"""element_at(transform(array({title}), title -> concat(title, ' ',
        array_join(transform({rest}, (w, j) -> {made}), ''))), 1)"""


def surrogate_sql(value: str, kind: str, nonce: str, key: str) -> str:
    """SQL of the surrogate of ``value``."""
    seed = f"concat_ws('|', {sql_text(key)}, {kind}, {value}, {nonce})"
    made = {
        "ip": f"array_join(transform(split({value}, '[.]'), (o, i) -> cast(1 + {_number('h', 'i')} % 254 AS string)), '.')",
        "card": _card(value, "h"),
        "phone": _like(value, "h", f"CASE WHEN startswith({value}, '+') THEN length(regexp_extract({value}, '^[+][0-9]{{1,3}}', 0)) ELSE 0 END"),
        "email": f"concat({_like(f'substring_index({value}, {sql_text(chr(46))}, size(split({value}, {sql_text("[.]")})) - 1)', 'h')}, '.', substring_index({value}, '.', -1))",
        "iban": f"concat(substr({value}, 1, 2), {_like(f'substr({value}, 3)', 'h')})",
        "key": f"CASE WHEN {value} RLIKE '^[0-9a-fA-F]+$' THEN {_hex_like(value, 'h')} ELSE {_like(value, 'h', '4')} END",
        "name": _name(value, key, nonce),
    }
    made["ssn"] = made["secret"] = _like(value, "h")
    # what a surrogate grows by: hexadecimal digits of the hash as digits or as letters
    digits, letters = "translate(h, 'abcdef', '012345')", "translate(h, '0123456789', 'ghijklmnop')"
    grown = {k: f"substr({letters}, 1, {nonce} div {WIDER})" for k in ("email", "iban", "secret")}
    grown |= {k: f"substr({digits}, 1, {nonce} div {WIDER})" for k in ("ip", "ssn", "card", "phone", "key")}
    grown["iban"] = f"upper({grown['iban']})"
    for k, more in grown.items():
        made[k] = f"concat({more}, {made[k]})" if k == "email" else f"concat({made[k]}, {more})"
    other = made.pop("secret")
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in made.items())
    return f"""element_at(transform(array(sha2({seed}, 512)), h -> CASE {kind} {whens} ELSE {other} END), 1)"""


def with_entities(docs: DataFrame, text: str, found: str) -> DataFrame:
    """``docs`` and an array of the entities (kind, value) in text order; empty where there is none."""
    values = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    none = F.array().cast("array<string>")
    values = F.when(F.col(text).rlike(HINT), values).otherwise(none)
    columns = [F.col(c) for c in docs.columns]
    rows = fixed_columns(docs, columns, **{found: F.coalesce(values, none)})
    kinds = f"transform({found}, v -> named_struct('kind', {_kind('v')}, 'value', v))"
    return fixed_columns(rows, columns, **{found: F.expr(kinds)})


def moved_entities(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, nonce) of the distinct entities whose first surrogate is taken; nonce is above 0."""
    rows = cut(entities.distinct().withColumn("nonce", F.lit(0)))
    while True:
        made = rows.withColumn("made", F.expr(surrogate_sql("value", "kind", "nonce", key)))
        # of those that share a surrogate the least value that hasn't moved yet keeps it
        firsts = made.groupBy("kind", "made").agg(F.min(F.struct("nonce", "value")).alias("first"))
        firsts = firsts.select("kind", "made", F.col("first.value").alias("first_value"))
        values = rows.select("kind", F.col("value").alias("made"), F.lit(True).alias("is_entity"))
        judged = made.join(firsts, ["kind", "made"]).join(values, ["kind", "made"], "left")
        taken = (F.col("value") != F.col("first_value")) | F.coalesce("is_entity", F.lit(False))
        rows = cut(judged.select("kind", "value", (F.col("nonce") + taken.cast("int")).alias("nonce"), taken.alias("taken")))
        if rows.where("taken").isEmpty():
            return rows.where("nonce > 0").select("kind", "value", "nonce")
        rows = rows.drop("taken")


def with_surrogates(docs: DataFrame, text: str = "text", key: str = "surrogates") -> DataFrame:
    """``docs`` with entities of ``text`` replaced, and ``n_entities``.

    A word of a titled name, wherever it stands again in the same text, alone or
    after another title (as in "Dr. Anna Kovacs ... Kovacs said ... Ms. Kovacs"),
    becomes the surrogate word of its first titled mention, so one person keeps
    one name within a document.  ``n_entities`` counts the
    entities the patterns find, and takes the place of a column of that name;
    other columns keep their names, whatever they are.
    """
    found, moved, own_text, made, out = (private(docs, f"pii_{x}") for x in ("found", "moved", "text", "made", "text_out"))
    columns = [F.col(c) for c in docs.columns]
    rows = with_entities(docs, text, found)
    entities = with_entities(docs.select(text).where(F.col(text).rlike(HINT)), text, found)
    entities = entities.select(F.inline(found))
    nonces = saved(moved_entities(entities, key))
    if nonces.isEmpty():
        rows = rows.withColumn(moved, F.expr("cast(map() AS map<string, int>)"))
    else:
        hashed = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
        texts = with_entities(docs.select(text).where(F.col(text).rlike(HINT)), text, found)
        pairs = texts.select(hashed.alias(own_text), F.inline(found)).distinct().join(nonces, ["kind", "value"])
        entry = F.struct(F.concat_ws("|", "kind", "value").alias("k"), "nonce")
        maps = pairs.groupBy(own_text).agg(F.map_from_entries(F.collect_set(entry)).alias(moved))
        rows = rows.join(saved(maps), hashed == F.col(own_text), "left")
    nonce = f"coalesce(element_at({moved}, concat_ws('|', e.kind, e.value)), 0)"
    surrogates = f"transform({found}, e -> {surrogate_sql('e.value', 'e.kind', nonce, key)})"
    pieces = f"split({text}, {sql_text(ANY)}, -1)"
    # coreference: a word of a titled name, standing elsewhere in the text alone, takes the
    # surrogate word of its first titled mention
    after_title = lambda v: f"split(substr({v}, length(substring_index({v}, ' ', 1)) + 2), '[ -]')"
    words = f"""flatten(transform({found}, (e, i) -> CASE WHEN e.kind = 'name' THEN
        zip_with({after_title('e.value')}, {after_title(f'get({made}, i)')}, (w, v) -> named_struct('word', w, 'sur', v))
        ELSE cast(array() AS array<struct<word:string,sur:string>>) END))"""
    firsts = f"filter({words}, (x, i) -> x.word <> '' AND NOT exists(slice({words}, 1, i), y -> y.word = x.word))"
    alone = "concat('(?<![\\\\p{L}\\\\p{N}])', m.word, '(?![\\\\p{L}\\\\p{N}])')"
    mapped = lambda v: f"aggregate({firsts}, {v}, (acc, m) -> regexp_replace(acc, {alone}, m.sur))"
    title = "substring_index(e.value, ' ', 1)"
    final = f"""transform({found}, (e, i) -> CASE WHEN e.kind = 'name'
        THEN concat({title}, ' ', {mapped(f"substr(e.value, length({title}) + 2)")}) ELSE get({made}, i) END)"""
    joined = f"""CASE WHEN size({found}) = 0 THEN {text}
        ELSE array_join(transform({pieces}, (p, i) -> concat({mapped('p')}, coalesce(get({final}, i), ''))), '') END"""
    rows = rows.withColumn(made, F.expr(surrogates)).withColumn(out, F.expr(joined))
    kept = [F.col(out).alias(text) if c == text else F.col(c) for c in docs.columns if c != "n_entities"]
    return rows.select(*kept, F.size(found).cast("bigint").alias("n_entities"))
