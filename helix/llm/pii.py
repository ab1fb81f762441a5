"""Surrogates for personal data: every detected entity is replaced, under a key, by one of its own type, gender, script and format.

Mentions are found by patterns. A mention has parts (a name has one for each word), and a part has a canonical form: an address in
lower case, a number's digits, a word in lower case. The table of distinct canonical forms gets surrogates from a keyed digest; a
surrogate that two forms share, or that is itself a form found in the corpus, is drawn again for all but one, until none is. So
different entities stay different, and one entity has one surrogate wherever and however it is written.

Everything is DataFrame expressions. Only documents with mentions take part in joins, which are on the canonical form; an entity
that a third of all documents name is one row on one side, and Spark's skew join splits the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helix.llm.shared import located, written

#: Titles by gender, and first and last names by script from which surrogates are put together.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "κυρία")}
NAMES = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leo", "Marco", "Nils", "Oscar", "Paul"),
    ("latin", "f"): ("Anna", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helga", "Irma", "Julia", "Karla", "Lena", "Maria", "Nora", "Olga", "Paula"),
    ("latin", "s"): ("Adler", "Bauer", "Castro", "Dubois", "Ekberg", "Fabre", "Garner", "Hansen", "Ibsen", "Jordan", "Keller", "Lambert", "Moreau", "Novak", "Olsen", "Palmer"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Инна", "Ксения"),
    ("cyrillic", "s"): ("Абрамов", "Белов", "Власов", "Громов", "Дубов", "Ершов", "Жуков", "Зимин"),
}
#: Consonants, vowels and endings by gender, from which further names are made up, by script.
SOUNDS = {
    "latin": ("bdfghklmnprstvwz", "aeiou", {"m": ("n", "r", "s", "l"), "f": ("a", "ia", "na", "la"), "s": ("er", "in", "ov", "ek")}),
    "cyrillic": ("бвгджзклмнпрстфх", "аеиоу", {"m": ("н", "р", "с", "л"), "f": ("а", "ия", "на", "ла"), "s": ("ов", "ин", "ев", "ко")}),
    "greek": ("βγδζθκλμνπρστφχψ", "αειου", {"m": ("ος", "ης", "ας", "ων"), "f": ("α", "η", "ια", "να"), "s": ("ιδης", "ου", "ακης", "ας")}),
    "armenian": ("բգդզթժլկհղմնպսվտ", "աեիոօ", {"m": ("ն", "ր", "կ", "մ"), "f": ("ա", "ինա", "իկ", "ուհի"), "s": ("յան", "յանց", "ունի", "ենց")}),
}
_TITLE = "|".join(sorted({t for ts in TITLES.values() for t in ts}, key=lambda t: (-len(t), t)))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET = r"\b(?:token|api[_-]?key|secret|password|passwd)\b"
#: A value without quotes, up to the mark at the end of a sentence.
_BARE = r"[^\s\"'<>,;]{5,}[^\s\"'<>,;.!?:)]"
#: In the order in which they are tried at a place.
PATTERNS = {
    "secret": rf"(?i:{_SECRET}\s*[=:]\s*[\"'])[^\"'\s]{{6,}}|(?i:{_SECRET}=|{_SECRET}\s*[=:]\s*(?=[^\s\"']*[0-9!@#$%^&*_])){_BARE}",
    # a name has 127 labels at most; the bound also keeps the matcher's stack small
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d.]?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
    r"|(?<![\d.,+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\d.,+-])0\d{1,4}[ ./-]\d{3,4}(?:[ .-]?\d{2,4}){1,2}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "number": r"(?<!\d)\d{9,12}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.?\s\p{{Lu}}[\p{{L}}'’-]+(?:\s\p{{Lu}}[\p{{L}}'’-]+){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of this has no mention.
MAYBE = rf"[@0-9]|(?:{_TITLE})\.?\s|(?i:token|key|secret|passw)"
DIGITS = ("phone", "ssn", "card", "number")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: From this draw on a surrogate has keyed characters that its shape doesn't give, one more with each draw, so that none can fail for ever.
LEAVE = 4


def kind_of(mention: Column) -> Column:
    """The type of a mention: the first pattern that is all of it."""
    return F.coalesce(*[F.when(mention.rlike(rf"^(?:{p})$"), k) for k, p in PATTERNS.items()], F.lit("number"))


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").when(word.rlike(r"\p{IsArmenian}"), "armenian").otherwise("latin")


def parts_of(kind: Column, mention: Column) -> Column:
    """A mention's parts: kind (with script and gender for names), canon, raw (as written)."""
    secret = F.regexp_extract(mention, r"^[^=:]*[=:]\s*[\"']?(.+)$", 1)
    raw = F.when(kind == "secret", secret).otherwise(mention)
    canon = F.when(kind.isin(*DIGITS), F.regexp_replace(raw, r"\D", "")).when(kind == "email", F.lower(raw)).otherwise(raw)
    one = F.array(F.struct(kind.alias("kind"), canon.alias("canon"), raw.alias("raw")))
    words = F.slice(F.split(mention, r"\s+"), 2, 10)
    gender = F.when(F.regexp_extract(mention, r"^[\p{L}]+", 0).isin(*TITLES["f"]), "f").otherwise("m")
    named = F.transform(words, lambda w, i: F.struct(F.concat_ws(" ", F.lit("name"), script_of(w), F.when(i == F.size(words) - 1, "s").otherwise(gender)).alias("kind"), F.lower(w).alias("canon"), w.alias("raw")))
    return F.when(kind == "name", named).otherwise(one)


#: A capitalised word, without what makes it a genitive.
WORD = r"(?<![\p{L}\d@._-])\p{Lu}\p{L}*+(?:['’-](?!s(?!\p{L}))\p{L}++)*+"


def renamed(text: Column, names: Column) -> Column:
    """text with each capitalised word that is one of names (a map from lower-cased words to kind and sub) replaced; and how many are, as struct(text, n)."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(w.alias("w"), F.element_at(names, F.lower(w)).alias("to")))
    new = F.transform(words, lambda x: F.when(x["to"].isNotNull(), rendered(x["to"]["kind"], x["w"], x["to"]["sub"])).otherwise(x["w"]))
    glued = F.array_join(F.zip_with(F.split(text, WORD, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.struct(glued.alias("text"), F.size(F.filter(words, lambda x: x["to"].isNotNull())).alias("n"))


def _digest(key: str, kind: Column, canon: Column, attempt: int) -> Column:
    """Two hex digits for each character of the canonical form, and 64 at least."""
    blocks = F.sequence(F.lit(0), F.floor(F.length(canon) / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(attempt)), b.cast("string")).cast("binary"), 256)), "")


def _value(digest: Column, i: Column) -> Column:
    """The digest's i-th byte, from 0."""
    return F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(canon: Column, digest: Column) -> Column:
    """Each letter becomes a letter and each digit a digit; what is all hexadecimal stays so; other characters stay."""
    hexadecimal = F.regexp_like(canon, F.lit("^[0-9a-f]+$")) & F.regexp_like(canon, F.lit("[a-f]"))

    def one(i: Column) -> Column:
        c, v = F.substr(canon, i + 1, F.lit(1)), _value(digest, i)
        letter = F.substr(F.lit(LETTERS), F.when(hexadecimal, v % 6).otherwise(v % 26) + 1, F.lit(1))
        capital = F.upper(letter)
        return F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), capital).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(canon) - 1), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum, modulo 10."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i + 1, F.lit(1)).cast("int")
        twice = F.when((n - 1 - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + twice

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10


def with_surrogate(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """entities (kind, canon) with sub, a surrogate's canonical form. Step by step, so that no expression is worked out twice."""
    kind, canon, d, shaped = (F.col(c) for c in ("kind", "canon", "_d", "_shaped"))
    e = entities.withColumn("_d", _digest(key, kind, canon, attempt))
    e = e.withColumn("_shaped", _shaped(canon, d))
    # an address keeps its last label
    email = F.concat(F.regexp_replace(shaped, r"[^.]*$", ""), F.substring_index(canon, ".", -1))
    ip = F.concat_ws(".", (_value(d, F.lit(0)) % 223 + 1).cast("string"), *[_value(d, F.lit(i)).cast("string") for i in (1, 2, 3)])
    e = e.withColumn("_first", F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(shaped, F.lit(2), F.length(shaped))))  # the country's or the brand's digit
    stem = F.substr("_first", F.lit(1), F.length("_first") - 1)
    # a card number that passes the Luhn test gets one that does
    e = e.withColumn("_sum", F.when(kind == "card", F.when(_luhn(canon) == 0, _luhn(F.concat(stem, F.lit("0"))))))
    card = F.when(F.col("_sum").isNull(), F.col("_first")).otherwise(F.concat(stem, ((10 - F.col("_sum")) % 10).cast("string")))
    names = F.lit(None).cast("string")
    one_of = lambda pool, i: F.element_at(F.array(*map(F.lit, pool)), _value(d, F.lit(i)) % len(pool) + 1)
    for script, (consonants, vowels, endings) in SOUNDS.items():
        for gender, last in endings.items():
            pool = NAMES.get((script, gender))
            # a known name at first, then one word of more syllables with each draw: 80, 6,400, 512,000... and the endings
            made = F.lower(one_of(pool, 0)) if pool and not attempt else F.concat(*[one_of(s, 2 * i + j) for i in range(attempt + (pool is None)) for j, s in enumerate((consonants, vowels))], one_of(last, 31))
            names = F.when(kind == f"name {script} {gender}", made).otherwise(names)
    sub = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", F.col("_first")).when(F.startswith(kind, F.lit("name ")), names).otherwise(shaped)
    if attempt >= LEAVE:
        more, hexa = attempt - LEAVE + 1, "0123456789abcdef"
        keyed = lambda n, to: F.translate(F.substr(F.reverse("_d"), F.lit(1), n), hexa, to)
        digits, letters = keyed(F.lit(more), "0123456789012345"), keyed(F.lit(more), "abcdefghijklmnop")
        ip = F.concat_ws(".", sub, *[_value(d, F.lit(4 + i)).cast("string") for i in range(more)])
        # nothing of a secret stays, as it may have no character that its shape changes
        secret = keyed(F.length(canon) + more, "abcdefghijklmnop")
        sub = F.when(kind == "secret", secret).when(kind == "email", F.concat(letters, sub)).when(kind == "ip", ip).when(kind.isin(*DIGITS), F.concat(sub, digits)).otherwise(sub)
    return e.withColumn("sub", sub).select("kind", "canon", "sub")


def rendered(kind: Column, raw: Column, sub: Column) -> Column:
    """The surrogate as the mention is written: the same separators between digits, the same case. What a later draw made longer stands at the end, or in lower case."""

    def digit(i: Column) -> Column:
        c = F.substr(raw, i + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(sub, F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)

    def cased(i: Column) -> Column:
        c, s = F.substr(raw, i + 1, F.lit(1)), F.substr(sub, i + 1, F.lit(1))
        return F.when(c.rlike(r"^\p{Lu}$"), F.upper(s)).otherwise(s)

    places = F.sequence(F.lit(0), F.length(raw) - 1)
    rest = F.substr(sub, F.length(F.regexp_replace(raw, r"\D", "")) + 1, F.length(sub))
    capitals = F.array_join(F.transform(F.split(sub, "-"), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2), F.length(w)))), "-")
    name = F.when((F.upper(raw) == raw) & (F.length(raw) > 1), F.upper(sub)).otherwise(capitals)
    return F.when(kind.isin(*DIGITS), F.concat(F.array_join(F.transform(places, digit), ""), rest)).when((kind == "email") & (F.length(sub) == F.length(raw)), F.array_join(F.transform(places, cased), "")).when(F.startswith(kind, F.lit("name ")), name).otherwise(sub)


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon; distinct) -> kind, canon, sub: no two of a kind share a sub, and no sub is a canon of its kind.

    Each draw is checked against the other draws, the accepted surrogates and the entities; those that fail are drawn again. As the failing ones get
    fewer each time, a few rounds do; names, whose pools are small, get a syllable more with each, and the others leave their shape from the draw LEAVE on.
    """
    entities = written(entities, "entities")
    real = entities.select("kind", F.col("canon").alias("sub"))
    done: list[DataFrame] = []
    left, attempt = entities, 0
    while True:
        drawn = with_surrogate(left, key, attempt)
        free = drawn.join(real, ["kind", "sub"], "left_anti")
        for d in done:
            free = free.join(d.select("kind", "sub"), ["kind", "sub"], "left_anti")
        done.append(written(free.groupBy("kind", "sub").agg(F.min("canon").alias("canon")), "surrogates"))
        left = written(left.join(done[-1].select("kind", "canon"), ["kind", "canon"], "left_anti"), "entities")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done).select("kind", "canon", "sub")
        attempt += 1


def replace_pii(docs: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """docs with every mention in text replaced, and n_entities, the number of mentions (of names without title, of words); all rows and other columns stay.

    A name is known by its title; its words are then replaced wherever they stand capitalised in the same document.

    A null text stays null and has no mentions; an empty table gives an empty table. Repeated rows get the same surrogates. A column of docs called n_entities is replaced.
    """
    rows = located(docs)
    t = F.col("row")[text]
    maybe = F.coalesce(t.rlike(MAYBE), F.lit(False))
    found = rows.select("_file", "_row", F.when(maybe, t).alias("_t")).filter("_t IS NOT NULL").select("_file", "_row", F.regexp_extract_all("_t", F.lit(ANY), F.lit(0)).alias("mentions")).filter(F.size("mentions") > 0)
    mentions = found.select("_file", "_row", F.posexplode("mentions").alias("at", "mention")).withColumn("kind", kind_of(F.col("mention")))
    parts = written(mentions.select("_file", "_row", "at", "mention", F.posexplode(parts_of(F.col("kind"), F.col("mention"))).alias("nth", "p")).select("_file", "_row", "at", "mention", "nth", "p.*"), "mentions")
    table = draw_surrogates(parts.select("kind", "canon").distinct(), key)
    drawn = parts.join(table, ["kind", "canon"]).select("_file", "_row", "at", "mention", "nth", "kind", "canon", "sub", "raw", rendered(F.col("kind"), F.col("raw"), F.col("sub")).alias("new"))
    # one row for each mention: what stands before its parts (a title, a secret's name) stays
    whole = drawn.groupBy("_file", "_row", "at", "mention").agg(F.array_sort(F.collect_list(F.struct("nth", "raw", "new"))).alias("p"))
    tail = F.array_join(F.transform("p", lambda x: x["new"]), " ")
    head = F.substr("mention", F.lit(1), F.length("mention") - F.length(F.array_join(F.transform("p", lambda x: x["raw"]), " ")))
    subs = whole.groupBy("_file", "_row").agg(F.array_sort(F.collect_list(F.struct("at", F.concat(head, tail).alias("new")))).alias("_subs"))
    # a name's words also stand without a title: those of a document's titled names, the last name first where a word is both
    word = drawn.filter(F.startswith("kind", F.lit("name "))).groupBy("_file", "_row", "canon").agg(F.max(F.struct("kind", "sub")).alias("to"))
    names = word.groupBy("_file", "_row").agg(F.map_from_entries(F.collect_list(F.struct("canon", "to"))).alias("_names"))
    # only documents with names have their other words looked up
    named = rows.join(names, ["_file", "_row"]).select("_file", "_row", F.transform(F.split(t, ANY, -1), lambda x: renamed(x, F.col("_names"))).alias("_pieces"))
    out = rows.join(subs.join(named, ["_file", "_row"], "left"), ["_file", "_row"], "left")
    pieces = F.coalesce(F.transform("_pieces", lambda x: x["text"]), F.split(t, ANY, -1))
    glued = F.array_join(F.zip_with(pieces, F.transform("_subs", lambda s: s["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    more = F.coalesce(F.aggregate("_pieces", F.lit(0), lambda n, x: n + x["n"]), F.lit(0))
    n = F.when(F.col("_subs").isNull(), 0).otherwise(F.size("_subs") + more).cast("long")
    new = F.when(F.col("_subs").isNull(), t).otherwise(glued)
    return out.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c != "n_entities"], n.alias("n_entities"))
