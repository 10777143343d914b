"""Surrogates for personal data: keyed, of the same kind and format, distinct and consistent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm.common import group_key, keep

# Titles tell a name's gender; the name is what follows.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "Κυρία"]

# A word of a name, or initials; small words that stand between them.
INITIALS = "(?:\\p{Lu}\\.-?)+|\\p{Lu}(?![\\p{L}'’-])"
NAME_WORD = f"(?:{INITIALS}|\\p{{Lu}}[\\p{{L}}'’-]{{1,60}}+)"
PARTICLE = "(?:van|von|zu|zur|de|der|den|del|della|di|da|do|dos|du|la|le|el|al|bin|ten|ter)"

# One pattern per kind, tried in this order at each place. Every run of characters is
# entered at its start only, so the search is linear in the text.
KINDS = {
    "secret": "(?i:(?<![a-z0-9_])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)"
    "\\s{0,3}[=:]\\s{0,3}[\"']?(?=[a-z/+_-]{0,60}[0-9])[a-z0-9/+_-]{8,}+)",
    "access_id": "(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]{0,63}+)"
    "@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}+)(?:\\.[A-Za-z0-9-]{1,63}+){0,8}(?<=\\.[A-Za-z]{2,24})",
    "ip": "(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\\.){3}"
    "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\\.[0-9])",
    "ipv6": "(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,40}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    "|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|:(?::[0-9A-Fa-f]{1,4}){1,7})"
    "(?![0-9A-Za-z:]|\\.[0-9])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": "(?<![0-9])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": "(?<![0-9+])(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{2,4}\\) ?|[0-9]{2,4}[ .-])"
    "[0-9]{3,4}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "name": f"(?<![\\p{{L}}])(?:{'|'.join(MALE + FEMALE)})\\.? {NAME_WORD}(?: (?:{PARTICLE} ){{0,3}}{NAME_WORD}){{0,8}}+",
}
PATTERN = "|".join(KINDS.values())

# Every match holds a digit, an at sign or one of these; texts without any are not searched.
SIGNS = "[0-9@]"
HINTS = ["AKIA", "ASIA", *sorted({t for t in MALE + FEMALE if not any(t != o and o in t for o in MALE + FEMALE)})]

# Syllables of made-up names: first part, last part of a male, a female, a family name.
SYLLABLES = {
    "Latin": ("ba be bo da de do fa fe ga ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se "
              "ta te ti to va ve vi", "n r s l", "na ra la sa", "nson ler mann ton rez"),
    "Cyrillic": ("ба бе бо да де до ка ке ла ле ли ло ма ме ми мо на не но па ра ре ри ро са се та те ва ве",
                 "н р с л", "на ра ла са", "нов рин ский лев тов"),
    "Greek": ("βα βε βο δα δε δο κα κε λα λε λι λο μα με μι μο να νε νο πα ρα ρε ρι σα σε τα τε", "ς ν",
              "να ρα λη", "δης πουλος κης"),
}
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
MAX_ATTEMPTS = 30

KEEP_PREFIX = "^(?i:[a-z_-]+\\s*[=:]\\s*[\"']?)"


def may_match(body: Column) -> Column:
    return body.rlike(SIGNS) | reduce(lambda a, b: a | b, [F.contains(body, F.lit(h)) for h in HINTS])


def _let(value: Column, body) -> Column:
    """Bind a value once for several uses."""
    return F.transform(F.array(value), body)[0]


def kind_of(match: Column) -> Column:
    """The first kind whose pattern takes the whole match."""
    return F.coalesce(*[F.when(match.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS.items()], F.lit("secret"))


def normal_form(match: Column, kind: Column) -> Column:
    """What tells two entities apart: letter case of an address and spacing of a number do not."""
    return F.when(kind == "email", F.lower(match)).when(
        kind.isin("card", "iban", "phone", "ssn"), F.regexp_replace(match, "[^A-Za-z0-9+]", "")
    ).when(kind == "name", F.regexp_replace(match, "^\\S+ ", "")).otherwise(match)


def _pick(letters: str, digest: Column, at) -> Column:
    place = F.pmod(F.xxhash64(digest, at), F.lit(len(letters)))
    return F.substring(F.lit(letters), (place + 1).cast("int"), F.lit(1))


def _scramble(value: Column, digest: Column, digits: str = DIGITS) -> Column:
    """Every letter and digit replaced by one of its class, all else kept.

    The n-th letter or digit depends on n alone, so spacing does not matter.
    """
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def changed(x: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^A-Za-z0-9]", ""))
        return (
            F.when(x.rlike("^[0-9]$"), _pick(digits, digest, at))
            .when(x.rlike("^[a-z]$"), _pick(LOWER, digest, at))
            .when(x.rlike("^[A-Z]$"), _pick(UPPER, digest, at))
            .otherwise(x)
        )

    return F.array_join(F.transform(chars, changed), "")


def _hex(value: Column, digest: Column) -> Column:
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: _pick(HEX, digest, i)), "")


def _digit_sum(digits: Column) -> Column:
    """Luhn's sum, the last digit counting once."""
    size = F.length(digits)
    values = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))
    weighed = F.transform(
        values,
        lambda v, i: F.when((size - i) % 2 == 1, v).when(v > 4, v * 2 - 9).otherwise(v * 2),
    )
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x)


def _card(value: Column, digest: Column) -> Column:
    """First digit and spacing kept; valid check digit if the original had one."""
    first = F.concat(F.substring(value, 1, 1), F.expr("''"))
    rest = _scramble(value.substr(F.lit(2), F.length(value)), digest)
    drawn = F.concat(first, rest)

    def checked(x: Column) -> Column:
        zeroed = F.concat(x.substr(F.lit(1), F.length(x) - 1), F.lit("0"))
        fix = F.pmod(10 - _digit_sum(F.regexp_replace(zeroed, "[^0-9]", "")), F.lit(10))
        return F.concat(x.substr(F.lit(1), F.length(x) - 1), fix.cast("string"))

    valid = _digit_sum(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0
    return F.when(valid, _let(drawn, checked)).otherwise(drawn)


def _ip(digest: Column) -> Column:
    """An address of the private net 10."""
    parts = [(F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(254)) + 1).cast("string") for k in range(3)]
    return F.concat_ws(".", F.lit("10"), *parts)


def _ipv6(value: Column, digest: Column) -> Column:
    """Colons kept; hexadecimal digits drawn, those that lead a group not zero."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(
        F.transform(chars, lambda c, i: F.when(c == ":", c).otherwise(_pick(HEX[1:], digest, i))), ""
    )


def _phone(value: Column, digest: Column) -> Column:
    """Country code, spacing and a fictional exchange 555 kept, the other digits drawn."""
    code = F.regexp_extract(value, "^(\\+[0-9]{1,3}[ .-]?)?", 0)
    rest = _scramble(value.substr(F.length(code) + 1, F.length(value)), digest)
    place = F.regexp_instr(value, F.lit("[) .-]555[ .-]"))
    with_exchange = F.concat(
        code, rest.substr(F.lit(1), place - F.length(code)), F.lit("555"),
        rest.substr(place - F.length(code) + 4, F.length(rest)),
    )
    return F.when(place > F.length(code), with_exchange).otherwise(F.concat(code, rest))


def _email(value: Column, digest: Column, key: str) -> Column:
    """Local part drawn in its format; the domain drawn by itself, so equal domains stay equal."""
    local = F.substring_index(value, "@", 1)
    domain = F.lower(F.substring_index(value, "@", -1))
    own = F.sha2(F.concat(F.lit(f"{key}|domain|"), domain), 256)
    label = _scramble(F.substring_index(domain, ".", 1), own)
    top = F.substring_index(domain, ".", -1)
    safe = F.when(top.isin("com", "net", "org"), top).otherwise(F.lit("com"))
    return F.concat(_scramble(local, digest), F.lit("@"), label, F.lit(".example."), safe)


def _drawn(syllables: str, digest: Column, at: int) -> Column:
    options = F.split(F.lit(syllables), " ")
    place = F.pmod(F.xxhash64(digest, F.lit(at)), F.lit(len(syllables.split())))
    return F.get(options, place.cast("int"))


def _name(value: Column, key: str, attempt: Column) -> Column:
    """Title kept; given name of the title's gender and family name in the name's script.

    A word's surrogate depends on the word, so a family keeps one name.
    """
    title = F.regexp_extract(value, "^\\S+ ", 0)
    words = F.split(value.substr(F.length(title) + 1, F.length(value)), " ")
    female = title.rlike(f"^(?:{'|'.join(FEMALE)})\\.? $")

    def word(w: Column, i: Column) -> Column:
        given = i < F.size(words) - 1
        digest = F.sha2(F.concat(F.lit(f"{key}|name|"), F.lower(w), F.lit("|"), attempt.cast("string")), 256)

        def made(script: str) -> Column:
            stem, male_end, female_end, family_end = SYLLABLES[script]
            start = F.concat(*[_drawn(stem, digest, k) for k in (1, 2)])
            third = F.when(given, F.lit("")).otherwise(_drawn(stem, digest, 3))
            more = F.when(attempt > 0, F.concat(*[_drawn(stem, digest, k) for k in (5, 6)])).otherwise(F.lit(""))
            end = F.when(given & female, _drawn(female_end, digest, 4)).when(
                given, _drawn(male_end, digest, 4)
            ).otherwise(_drawn(family_end, digest, 4))
            return F.concat(start, third, more, end)

        drawn = F.when(w.rlike("\\p{IsCyrillic}"), made("Cyrillic")).when(
            w.rlike("\\p{IsGreek}"), made("Greek")
        ).otherwise(made("Latin"))
        proper = F.concat(F.upper(F.substring(drawn, 1, 1)), drawn.substr(F.lit(2), F.length(drawn)))

        def initials(letters: str) -> Column:
            each = F.filter(F.split(w, ""), lambda c: c != "")
            return F.array_join(
                F.transform(each, lambda c, k: F.when(c.rlike("\\p{L}"), _pick(letters, digest, k)).otherwise(c)), ""
            )

        short = F.when(w.rlike("\\p{IsCyrillic}"), initials("АБВГДЕЗИКЛМНОПРСТ")).when(
            w.rlike("\\p{IsGreek}"), initials("ΑΒΓΔΕΖΗΙΚΛΜΝΟΠΡΣΤ")
        ).otherwise(initials(UPPER))
        return F.when(w.rlike(f"^(?:{INITIALS})$"), short).when(w.rlike(f"^{PARTICLE}$"), w).when((F.upper(w) == w) & (F.length(w) > 1), F.upper(drawn)).otherwise(proper)

    return F.concat(title, F.array_join(F.transform(words, word), " "))


def surrogate(match: Column, kind: Column, key: str, attempt: Column) -> Column:
    """The replacement of one match; another attempt gives another one."""
    digest = F.sha2(
        F.concat_ws("|", F.lit(key), kind, normal_form(match, kind), attempt.cast("string")), 256
    )
    secret = F.regexp_extract(match, KEEP_PREFIX, 0)
    value = match.substr(F.length(secret) + 1, F.length(match))

    def replaced(d: Column) -> Column:
        return (
            F.when(kind == "email", _email(match, d, key))
            .when(kind == "ip", _ip(d))
            .when(kind == "ipv6", _ipv6(match, d))
            .when(kind == "card", _card(match, d))
            .when(kind == "phone", _phone(match, d))
            .when(kind == "name", _name(match, key, attempt))
            .when(kind == "access_id", F.concat(F.substring(match, 1, 4), _scramble(match.substr(F.lit(5), F.length(match)), d)))
            .when(kind == "iban", F.concat(F.substring(match, 1, 2), _scramble(match.substr(F.lit(3), F.length(match)), d)))
            .when(kind == "ssn", _scramble(match, d))
            .when(value.rlike("^[0-9a-f]+$"), F.concat(secret, _hex(value, d)))
            .otherwise(F.concat(secret, _scramble(value, d)))
        )

    return _let(digest, replaced)


def _settle(found: DataFrame, key: str) -> DataFrame:
    """Attempt numbers of the entities whose first surrogate is taken: _form, _attempt.

    ``found`` has one row per kind and normal form, with one spelling of it. Within a
    kind no two entities get the same surrogate, and none gets one that is itself an
    entity of the corpus. The least of those that collide keeps its surrogate, the
    others draw again.
    """
    def drawn(df: DataFrame) -> DataFrame:
        made = df.withColumn("_made", surrogate(F.col("_match"), F.col("_kind"), key, F.col("_attempt")))
        form = normal_form(F.col("_made"), F.col("_kind"))
        return made.withColumn("_made_form", F.concat("_kind", F.lit("|"), form))

    state = keep(drawn(found.withColumn("_attempt", F.lit(0))), "surrogates")
    for _ in range(MAX_ATTEMPTS):
        owners = state.groupBy("_made_form").agg(F.min("_form").alias("_owner"), F.count(F.lit(1)).alias("_n"))
        taken = owners.where("_n > 1").select("_made_form", "_owner")
        originals = state.select(F.col("_form").alias("_made_form"), F.lit(True).alias("_is_original"))
        clash = keep(
            state.join(taken, "_made_form", "left").join(originals, "_made_form", "left").where(
                F.col("_is_original") | (F.col("_owner") != F.col("_form"))
            ).select("_form"),
            "clashes",
        )
        if clash.isEmpty():
            break
        again = state.join(clash.withColumn("_again", F.lit(True)), "_form", "left")
        fresh = again.where("_again").withColumn("_attempt", F.col("_attempt") + 1)
        calm = again.where(F.col("_again").isNull()).drop("_again")
        state = keep(calm.unionByName(drawn(fresh.drop("_again", "_made", "_made_form"))), "surrogates")
    return state.where("_attempt > 0").select("_form", "_attempt")


def _aliases(found: Column, new: Column) -> Column:
    """What else a text may call its titled people, longest first, and by what: arrays old, new.

    The whole name without the title, and the family name if it is no initial.
    """
    named = F.filter(F.arrays_zip(found.alias("old"), new.alias("new")), lambda p: kind_of(p["old"]) == "name")

    def untitled(x: Column) -> Column:
        return F.regexp_replace(x, "^\\S+ ", "")

    def family(x: Column) -> Column:
        return F.substring_index(x, " ", -1)

    def pair(old: Column, made: Column) -> Column:
        return F.struct((-F.length(old)).alias("n"), old.alias("old"), made.alias("new"))

    whole = F.transform(named, lambda p: pair(untitled(p["old"]), untitled(p["new"])))
    last = F.transform(named, lambda p: pair(family(p["old"]), family(p["new"])))
    every = F.filter(F.concat(whole, last), lambda p: ~p["old"].rlike(f"^(?:{INITIALS})$"))
    return F.array_sort(F.array_distinct(every))


def _renamed(gap: Column, aliases: Column) -> Column:
    """The text between two entities with the aliases in it replaced, and how many: text, n."""
    escaped = F.transform(aliases, lambda p: F.regexp_replace(p["old"], "\\.", "\\\\\\."))
    pattern = F.concat(F.lit("(?<![\\p{L}])(?:"), F.array_join(escaped, "|"), F.lit(")(?![\\p{L}])"))
    old, new = F.transform(aliases, lambda p: p["old"]), F.transform(aliases, lambda p: p["new"])

    def swapped(hits: Column) -> Column:
        parts = F.split(gap, pattern, -1)
        swaps = F.transform(hits, lambda h: F.get(new, (F.array_position(old, h) - 1).cast("int")))
        return F.struct(
            F.array_join(F.transform(parts, lambda g, i: F.concat(g, F.coalesce(F.get(swaps, i), F.lit("")))), "").alias("text"),
            F.size(hits).alias("n"),
        )

    return F.when(F.size(aliases) > 0, _let(F.regexp_extract_all(gap, pattern, F.lit(0)), swapped)).otherwise(
        F.struct(gap.alias("text"), F.lit(0).alias("n"))
    )


def replace_entities(
    docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All rows and columns of ``docs``, the text's entities replaced, and n_entities (long).

    Equal entities get equal surrogates in the whole table, distinct ones distinct
    surrogates of the same kind, script and format; the key decides which. Further
    mentions of a text's titled names, whole or by the family name, get the same
    surrogate and count. A null text
    stays null; texts without entities are unchanged to the byte. Repeated rows are
    replaced alike. If ``docs`` has a column n_entities of its own, it gives way. An
    empty table gives an empty one. Native functions only. Texts are not moved; what is
    gathered are distinct entities, and per document the few that had to draw again.
    """
    body = F.col(f"`{text}`")
    matches = F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))
    some = may_match(body) & body.rlike(PATTERN)
    mentions = keep(
        docs.where(some).select(group_key(F.col(id_col)).alias("_doc"), F.explode(matches).alias("_match"))
        .select("_doc", "_match", kind_of(F.col("_match")).alias("_kind"))
        .withColumn("_form", F.concat("_kind", F.lit("|"), normal_form(F.col("_match"), F.col("_kind")))),
        "mentions",
    )
    found = mentions.groupBy("_kind", "_form").agg(F.min("_match").alias("_match"))
    redrawn = keep(_settle(found, key), "redrawn")
    # Entities that draw again are rare: two of one kind whose digests agree in format.
    per_doc = keep(
        mentions.select("_doc", "_form").join(redrawn, "_form").distinct().groupBy("_doc").agg(
            F.map_from_entries(F.collect_list(F.struct("_form", "_attempt"))).alias("_redrawn")
        ),
        "redrawn-by-document",
    )
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        body.alias("_text"),
        group_key(F.col(id_col)).alias("_doc"),
    ).join(per_doc, "_doc", "left")
    matches = F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0))
    gaps = F.split("_text", PATTERN, -1)
    no_map = F.create_map().cast("map<string,int>")
    pieces = whole.select(
        "_row", "_text", F.coalesce("_redrawn", no_map).alias("_redrawn"),
        F.when(may_match(F.col("_text")) & F.col("_text").rlike(PATTERN), F.struct(gaps.alias("gaps"), matches.alias("found"))).alias("_cut"),
    )

    def new(m: Column) -> Column:
        def of_kind(kind: Column) -> Column:
            form = F.concat(kind, F.lit("|"), normal_form(m, kind))
            attempt = F.coalesce(F.try_element_at("_redrawn", form), F.lit(0))
            return _let(attempt, lambda a: surrogate(m, kind, key, a))

        return _let(kind_of(m), of_kind)

    swapped = F.transform("_cut.found", new)
    joined = F.array_join(
        F.transform("_gaps", lambda g, i: F.concat(g["text"], F.coalesce(F.get("_new", i), F.lit("")))), ""
    )
    made = pieces.select("_row", "_text", "_cut", F.when(F.col("_cut").isNotNull(), swapped).alias("_new"))
    made = made.withColumn("_aliases", _aliases(F.col("_cut.found"), F.col("_new"))).withColumn(
        "_gaps", F.transform("_cut.gaps", lambda g: _renamed(g, F.col("_aliases")))
    )
    further = F.aggregate("_gaps", F.lit(0), lambda n, g: n + g["n"])
    others = [F.col(f"_row.`{c}`") for c in docs.columns if c not in (text, "n_entities")]
    return made.select(
        *others,
        F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(joined).alias(text),
        F.coalesce(F.size("_new") + further, F.lit(0)).cast("long").alias("n_entities"),
    )
