"""PII: keyed, type-consistent surrogates for personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import parallelism, row_key, stored

KEY = "clientlens-surrogates"
# Titles by gender, forms of entities (Java regular expressions; first match wins).
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Lady", "Dame", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Г-жа", "Κυρία"],
    "m": ["Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Г-н", "Κύριος"],
    "": ["Doctor", "Dr", "Professor", "Prof"],
}
_TITLE = "(?:" + "|".join(sorted(sum(TITLES.values(), []), key=lambda x: (-len(x), x))) + r")\.?(?: (?:Dr|Prof)\.?)? "
_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?"
_NAMES = rf"{_NAME}(?:-{_NAME})*"
#: Small words inside names; they stay, and never end a name.
PARTICLES = ["von", "van", "der", "den", "dem", "zu", "zur", "de", "del", "della", "di", "da", "do", "dos", "du", "des", "la", "le", "las", "los", "y", "e", "af", "av"]
_SOME = "(?:(?:" + "|".join(PARTICLES) + ") ){1,3}"
_PARTICLES = f"(?:{_SOME})?"
FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++(?<!\.)@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "secret": r"(?<![\p{L}\p{N}])(?:(?=[a-f]*[0-9])[0-9a-f]{32,128}|(?=[A-F]*[0-9])[0-9A-F]{32,128}|(?:sk|pk|rk)[_-][\p{L}\p{N}_\-]{16,64}|gh[pousr]_[\p{L}\p{N}]{20,64}|AKIA[0-9A-Z]{16})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?!\.?[\p{L}0-9])",
    "ssn": r"(?<![\p{L}\p{N}\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\-\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.\-])(?:(?:[0-9]{4}[ \-]){3}[0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{13,19})(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}.\-])(?:(?:\+|00)[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{2,4}[ .\-])[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\+[0-9]{9,14}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}{_PARTICLES}{_NAMES}(?: {_PARTICLES}{_NAMES}){{0,2}}(?: {_SOME}{_NAMES}){{0,2}}",
}
PREFIX = r"^((?:sk|pk|rk)[_-](?:(?:live|test|proj)[_-])?|gh[pousr]_|AKIA)"
PATTERN = "|".join(f"(?:{p})" for p in FORMS.values())
#: Every form has one of these signs; texts without any are not searched further.
#: One class of first characters, then a look at what follows: a fast scan.
_INITIALS = "".join(sorted({t[0] for t in sum(TITLES.values(), [])}))
NEEDED = (
    rf"[0-9@A-Zspgr{_INITIALS}](?<=[0-9@]|[spr](?=k[_-])|g(?=h[pousr]_)|A(?=KIA)|"
    rf"(?={_TITLE}{_PARTICLES}\p{{Lu}})[{_INITIALS}])"
)
DIGITS, HEX = "0123456789", "0123456789abcdef"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Syllables and endings of made names, by script and gender.
SYLLABLES = {
    "latin": ("b br c d dr f g gr h k l m n p r s t v w".split(), "a e i o u".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split()),
    "greek": ("β γ δ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο η".split()),
}
ENDINGS = {
    "latin": {"f": ["na", "ra", "lia", "nette"], "m": ["n", "rd", "las", "mir"], "": ["ly", "rin", "sey", "mi"], "family": ["son", "berg", "ley", "mann", "ton", "well", "ett", "ford"]},
    "cyrillic": {"f": ["на", "ра", "лия"], "m": ["н", "р", "слав"], "": ["ша", "ня"], "family": ["ов", "ин", "ский"], "family_f": ["ова", "ина", "ская"]},
    "greek": {"f": ["να", "ρα", "νη"], "m": ["νος", "ρης", "λας"], "": ["νι", "λι"], "family": ["ίδης", "όπουλος", "άκης"], "family_f": ["ίδου", "οπούλου", "άκη"]},
}
RETRIES = 60


def _kind(m: Column) -> Column:
    """Kind of a match; a bare mention of a known name has no form of its own."""
    out = F.lit("mention")
    for kind, p in reversed(list(FORMS.items())):
        out = F.when(m.rlike(f"^(?:{p})$"), F.lit(kind)).otherwise(out)
    return (
        F.when((out == "card") & (~m.rlike("^[2-6]") | (_luhn_sum(_digits(m)) % 10 != 0)), F.lit("kept"))
        .when((out == "iban") & (_mod97(_compact(m)) != 1), F.lit("kept")).otherwise(out)
    )


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def _mod97(iban: Column) -> Column:
    """An IBAN's remainder: the first four moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _luhn_sum(number: Column) -> Column:
    """Sum of digits, every second one from the right doubled."""
    n = F.length(number)

    def add(acc, i):
        d = F.substring(number, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add))


def _part(kind, canon, before, form, sex):
    return F.struct(kind.alias("kind"), canon.alias("canon"), before.alias("before"), form.alias("form"), sex.alias("sex"))


def _named(m: Column) -> Column:
    """Parts of a titled mention: of its words the last is the family name, those
    before it given names; particles stay; words come apart at hyphens."""
    title = F.regexp_extract(m, f"^{_TITLE}", 0)
    words = F.split(F.substring(m, F.length(title) + 1, F.length(m)), " ")
    bare = F.regexp_extract(title, r"^[^. ]+", 0)
    sex = F.when(bare.isin(TITLES["f"]), F.lit("f")).when(bare.isin(TITLES["m"]), F.lit("m")).otherwise(F.lit(""))

    def pieces(w, k):
        kind = F.when(w.isin(PARTICLES), F.lit("kept")).when(k == F.size(words) - 1, F.lit("family")).otherwise(F.lit("given"))
        before = lambda j: F.when(j > 0, F.lit("-")).when(k > 0, F.lit(" ")).otherwise(title)
        return F.transform(F.split(w, "-"), lambda p, j: _part(kind, F.lower(p), before(j), p, sex))

    return F.flatten(F.transform(words, pieces))


def _parts(m: Column, family: Column) -> Column:
    """(kind, canon, before, form, sex): canon names the entity whatever its form, so
    that the same number or name written differently keeps one surrogate.
    ``family``: the family names that titled mentions of the same text gave."""
    none = F.lit("")

    def other(kind):
        number = _digits(m)
        canon = (
            F.when(kind == "phone", F.when(F.length(number) > 10, F.right(number, F.lit(10))).otherwise(number))
            .when(kind.isin("card", "ssn"), number).when(kind == "iban", _compact(m))
            .when(kind.isin("secret", "kept"), m).otherwise(F.lower(m))
        )
        bare = F.when(F.array_contains(family, F.lower(m)), F.lit("family")).otherwise(F.lit("given"))
        return F.when(kind == "name", _named(m)).otherwise(F.array(_part(F.when(kind == "mention", bare).otherwise(kind), canon, none, m, none)))

    return F.get(F.transform(F.array(_kind(m)), other), F.lit(0))


def _byte(digest: Column, i) -> Column:
    at = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(digest, (at * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, b: Column) -> Column:
    return F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _one_of(words: list[str], b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), b % len(words) + 1)


def _check_digit(body: Column) -> Column:
    return ((F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")


def _made_name(kind: Column, canon: Column, sex: Column, attempt: Column, digest: Column) -> Column:
    """Syllables and an ending of the name's script and gender; every few attempts
    a syllable more, so that names cannot run out."""

    def made(script):
        onsets, vowels = SYLLABLES[script]
        count = F.lit(2) + F.floor(attempt / 3).cast("int")
        body = F.array_join(
            F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(_one_of(onsets, _byte(digest, 2 * i)), _one_of(vowels, _byte(digest, 2 * i + 1)))), ""
        )
        ends, b = ENDINGS[script], _byte(digest, 60)
        family = _one_of(ends["family"], b)
        if "family_f" in ends:
            family = F.when(canon.rlike("(?:а|я|ου|η)$"), _one_of(ends["family_f"], b)).otherwise(family)
        given = F.when(sex == "f", _one_of(ends["f"], b)).when(sex == "m", _one_of(ends["m"], b)).otherwise(_one_of(ends[""], b))
        return F.concat(body, F.when(kind == "family", family).otherwise(given))

    return F.when(canon.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def _digest(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), canon), 512)


def surrogate(kind: Column, canon: Column, attempt: Column, sex: Column, key: str = KEY, digest: Column | None = None) -> Column:
    """A keyed stand-in for an entity of its kind: keys keep their prefix and
    classes of characters, cards their first digit and check, IBANs their country
    and check, addresses their kind of network, social security numbers are
    issuable ones, names sound like names of their script and gender.  ``digest``:
    a column that holds the digest, which each character would else make anew."""
    digest = _digest(kind, canon, attempt, key) if digest is None else digest
    chars = lambda c, f: F.array_join(F.transform(F.split(c, ""), f), "")
    number = lambda c: chars(c, lambda x, i: _pick(DIGITS, _byte(digest, i)))
    by_class = lambda x, i: (
        F.when(x.rlike("[0-9]"), _pick(DIGITS, _byte(digest, i))).when(x.rlike(r"\p{Lu}"), _pick(UPPER, _byte(digest, i)))
        .when(x.rlike(r"\p{L}"), _pick(LOWER, _byte(digest, i))).otherwise(x)
    )
    prefix = F.regexp_extract(canon, PREFIX, 1)
    secret = (
        F.when(canon.rlike("^[0-9a-f]+$"), chars(canon, lambda x, i: _pick(HEX, _byte(digest, i))))
        .when(canon.rlike("^[0-9A-F]+$"), chars(canon, lambda x, i: _pick(HEX.upper(), _byte(digest, i))))
        .otherwise(F.concat(prefix, chars(F.substring(canon, F.length(prefix) + 1, F.length(canon)), by_class)))
    )
    more = F.translate(F.substring(digest, F.lit(1), F.greatest(attempt - 3, F.lit(0))), HEX, "ghijklmnopabcdef")  # so that short ones cannot run out
    mail = F.concat(more, chars(F.regexp_extract(canon, r"^(.*)\.", 1), by_class), F.regexp_extract(canon, r"(\.[^.]*)$", 1))
    kept = F.regexp_extract(canon, r"^(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)", 1)  # private stays private
    octet = lambda i: ((_byte(digest, i * 2) * 256 + _byte(digest, i * 2 + 1)) % 254 + 1).cast("string")
    kept = F.when(attempt < 8, kept).when((attempt < 20) & (F.length(kept) > 0), F.lit("10.")).otherwise(F.lit(""))
    lead = F.size(F.split(kept, r"\.")) - 1
    rest = F.array_join(F.transform(F.sequence(F.lit(1), 4 - lead), lambda i: octet(i)), ".")
    groups = F.array_join(
        F.transform(
            F.split(canon, ":"),
            lambda g, k: F.when((k == 0) | (g == ""), g).otherwise(
                F.concat(_pick("123456789abcdef", _byte(digest, 4 * k)), F.substring(F.substring(digest, 8 * k + 3, F.lit(3)), F.lit(1), F.length(g) - 1 + F.floor(attempt / 3).cast("int")))
            ),
        ), ":",
    )
    body = F.concat(F.left(canon, F.lit(1)), number(F.substring(canon, F.lit(2), F.length(canon) - 2)))
    bban = chars(F.substring(canon, F.lit(5), F.length(canon)), by_class)
    country = F.left(canon, F.lit(2))
    check = F.lpad((F.lit(98) - _mod97(F.concat(country, F.lit("00"), bban))).cast("string"), 2, "0")
    number3 = lambda i: _byte(digest, i) * 65536 + _byte(digest, i + 1) * 256 + _byte(digest, i + 2)
    ssn = F.concat(F.lpad((number3(0) % 665 + 1).cast("string"), 3, "0"), F.lpad((number3(3) % 99 + 1).cast("string"), 2, "0"), F.lpad((number3(6) % 9999 + 1).cast("string"), 4, "0"))
    phone = F.concat(F.when(canon.startswith("0"), F.lit("0")).otherwise(_pick("23456789", _byte(digest, 0))), number(F.substring(canon, F.lit(2), F.length(canon))).substr(F.lit(1), F.length(canon) - 1))
    return (
        F.when(kind == "ip", F.concat(kept, rest)).when(kind == "ipv6", groups).when(kind == "card", F.concat(body, _check_digit(body)))
        .when(kind == "email", mail).when(kind == "secret", secret).when(kind == "iban", F.concat(country, check, bban))
        .when(kind == "ssn", ssn).when(kind == "phone", phone).otherwise(_made_name(kind, canon, sex, attempt, digest))
    )


def _formed(kind: Column, form: Column, made: Column) -> Column:
    """``made`` in the form of a mention: digits in its digits' places from the
    right, an IBAN's groups, capitals where it has them."""
    letters = F.split(form, "")
    total = F.length(_digits(form))

    def slot(c, i):
        nth = F.length(made) - total + F.length(_digits(F.substring(form, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]") & (nth >= 1), F.substring(made, nth, F.lit(1))).otherwise(c)

    spaced = F.transform(letters, lambda c, i: F.when(c == " ", c).otherwise(F.substring(made, F.length(_compact(F.substring(form, F.lit(1), i + 1))), F.lit(1))))
    cased = F.transform(F.split(made, ""), lambda c, i: F.when(F.substring(form, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    title = F.concat(F.upper(F.left(made, F.lit(1))), F.substring(made, F.lit(2), F.length(made)))
    name = F.when((F.length(form) > 1) & (F.upper(form) == form), F.upper(made)).otherwise(title)
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.array_join(F.transform(letters, slot), "")).when(kind.isin("given", "family"), name)
        .when(kind == "iban", F.array_join(spaced, "")).when(kind.isin("email", "ipv6"), F.array_join(cased, "")).otherwise(made)
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, made) with all ``made`` of a kind distinct and none equal to
    an entity of the corpus.

    Every round derives stand-ins on the cluster and looks for collisions by a
    partial aggregation on (kind, made); all but one of the colliding entities,
    and those that hit a real one, derive again with the next attempt.  Only a
    count comes to the driver.  A given name takes the gender that most of its
    titles have.  An error tells that a kind has more entities than numbers.
    """
    n = parallelism(entities.sparkSession)
    sex = F.col("sex") if "sex" in entities.columns else F.lit("")
    votes = F.sum(F.when(sex == "f", 1).when(sex == "m", -1).otherwise(0))
    real = entities.groupBy("kind", "canon").agg(F.when(votes > 0, "f").when(votes < 0, "m").otherwise("").alias("sex"))
    real = stored(real.withColumn("attempt", F.lit(0)), "pii-entities")
    fixed = None
    todo = real
    for _ in range(RETRIES):
        todo = todo.repartition(n, "kind", "canon")
        # the digest is a column of its own: its one evaluation a row, and a far smaller expression
        e = [F.col(c) for c in ("kind", "canon", "attempt")]
        with_digest = todo.withColumn("_digest", _digest(*e, key))
        made = stored(with_digest.withColumn("made", surrogate(*e, F.col("sex"), key, F.col("_digest"))).drop("_digest"), "pii-made")
        first = made.groupBy("kind", "made").agg(F.min("canon").alias("owner"))
        taken = real.select("kind", F.col("canon").alias("made"), F.lit(True).alias("hit"))
        if fixed is not None:
            taken = taken.union(fixed.select("kind", "made", F.lit(True)))
        judged = made.join(first, ["kind", "made"]).join(taken.distinct(), ["kind", "made"], "left")
        judged = stored(judged.withColumn("ok", F.col("hit").isNull() & (F.col("owner") == F.col("canon"))), "pii-judged")
        good = judged.where("ok").select("kind", "canon", "made")
        fixed = good if fixed is None else fixed.union(good)
        todo = judged.where("not ok").select("kind", "canon", "sex", (F.col("attempt") + 1).alias("attempt"))
        if not todo.limit(1).count():
            return fixed
    raise RuntimeError(f"surrogates still collide after {RETRIES} rounds")


def surrogate_text(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Every row of ``docs`` with personal data in its text replaced; adds
    n_entities and kinds (sorted names of the kinds found, comma between).

    The same entity gets the same surrogate in every document and form.  Names are
    found after a title; the words of such a name are then replaced wherever they
    stand in the same text, with a title or without.  Names that no title
    introduces in their text stay.  Card numbers (which start with 2 to 6) and IBANs
    count only if their check digits hold; other long numbers stay.

    Defined cases: null text stays null, with 0 entities; rows that repeat are
    treated alike; a null doc_id is like any other; an empty table gives no rows;
    columns named like an output are replaced.

    Plan: texts without entities never move; those with some are written once and
    cross one exchange by row key.  A mention moves by its entity, and the entity
    table is written first, so that a frequent entity is a join that can be split.
    """
    made = ("n_entities", "kinds")
    kept = [c for c in docs.columns if c not in made]
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    d = docs.select(*kept).withColumn("_ents", F.when(F.col("text").rlike(NEEDED), found).otherwise(F.array().cast("array<string>")))
    named = F.flatten(F.transform(F.filter("_ents", lambda m: m.rlike(f"^(?:{FORMS['name']})$")), _named))
    known = lambda kind: F.array_distinct(F.transform(F.filter("_named", lambda p: p["kind"] == kind), lambda p: p["form"]))
    words = F.array_distinct(F.concat("_family", "_given", F.transform(F.concat("_family", "_given"), F.upper)))
    longest = F.array_join(F.reverse(F.array_sort(F.transform(words, lambda w: F.concat(F.lpad(F.length(w).cast("string"), 9, "0"), w)))), "|")
    anywhere = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.regexp_replace(longest, r"(^|\|)[0-9]{9}", "$1"), F.lit(r")(?![\p{L}\p{N}])"))
    plain = F.size("_named") == 0
    some = d.where(F.size("_ents") > 0).withColumn("_named", named).withColumn("_family", known("family")).withColumn("_given", known("given"))
    some = some.withColumn("_rk", row_key()).withColumn("_all", F.when(plain, F.lit(PATTERN)).otherwise(anywhere)).withColumns({
        "_ents": F.when(plain, F.col("_ents")).otherwise(F.regexp_extract_all("text", F.col("_all"), F.lit(0))),
        "_gaps": F.when(plain, F.split("text", PATTERN, -1)).otherwise(F.split("text", F.col("_all"), -1)),
    })
    some = stored(some.withColumn("_family", F.transform("_family", F.lower)).select(*kept, "_rk", "_ents", "_gaps", "_family"), "pii-texts")
    hits = (
        some.select("_rk", "_family", F.posexplode("_ents").alias("pos", "m"))
        .select("_rk", "pos", F.posexplode(_parts(F.col("m"), F.col("_family"))).alias("part", "p"))
        .select("_rk", "pos", "part", "p.*").distinct()
    )
    hits = stored(hits, "pii-mentions")
    table = stored(surrogates(hits.where("kind <> 'kept'").select("kind", "canon", "sex"), key), "pii-surrogates")
    out = F.when(F.col("made").isNull(), F.col("form")).otherwise(_formed(F.col("kind"), F.col("form"), F.col("made")))
    item = F.struct("pos", "part", F.concat("before", out).alias("out"), "kind")
    new = hits.join(table, ["kind", "canon"], "left").groupBy("_rk").agg(F.sort_array(F.collect_list(item)).alias("_new"))
    text = F.concat(
        F.array_join(F.transform("_new", lambda x: F.concat(F.when(x["part"] == 0, F.element_at("_gaps", x["pos"] + 1)).otherwise(""), x["out"])), ""),
        F.element_at("_gaps", -1),
    )
    real = F.filter("_new", lambda x: x["kind"] != "kept")
    places = F.array_distinct(F.transform(real, lambda x: x["pos"]))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(real, lambda x: F.when(x["kind"].isin("given", "family"), "name").otherwise(x["kind"])))), ",")
    changed = some.join(new, "_rk").select(
        *[text.alias("text") if c == "text" else c for c in kept], F.size(places).cast("long").alias("n_entities"), kinds.alias("kinds")
    )
    same = d.where(F.size("_ents") == 0).select(*kept, F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return same.unionByName(changed)


def op7(spark, sf_dir: str) -> DataFrame:
    return surrogate_text(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
