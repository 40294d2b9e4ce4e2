"""Names and file names mentioned in answers, and the links put behind them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docintake.fixed_values import FILE_MENTION
from docintake.functions import text
from docintake.operators import automaton
from docintake.operators.ordering import elements
from docintake.session import written

WORDS = r"[\p{L}\p{N}_]+"
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
KEY_WORDS = 4
#: Answers of one word run that stay together in the join.
KEY_ROWS = 100_000


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORDS})"), F.lit(1))


def word_key(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def candidates(answers: DataFrame, names: DataFrame, key_words: int = KEY_WORDS, key_rows: int = KEY_ROWS) -> DataFrame:
    """Pairs ``(id, name)`` that share the first words (up to ``key_words``) of the name, for name tables of any size.

    A semi-join leaves the places of the answers where some name's first word
    stands; only from those are runs built, of the lengths that occur.  A run
    that more than ``key_rows`` answers hold is dealt over several copies of
    its names, so no task gets all answers of a common word.
    """
    keyed = names.select("name", words_of(F.col("name")).alias("w")).where(F.size("w") > 0)
    keyed = keyed.select(
        "name",
        F.least(F.size("w"), F.lit(key_words)).alias("n"),
        F.element_at("w", 1).alias("first"),
        word_key(F.col("w"), key_words).alias("key"),
    )
    keyed = written(keyed, "name-keys")
    lengths = sorted(r.n for r in keyed.select("n").distinct().collect())  # key_words at most
    if not lengths:
        return answers.select("id", F.lit("").alias("name")).limit(0)

    told = answers.select("id", words_of(F.col("answer")).alias("w")).where(F.size("w") > 0)
    places = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.slice("w", i, lengths[-1]))
    starts = told.select("id", F.explode(elements(F.array_distinct(places))).alias("at"))
    starts = starts.withColumn("first", F.element_at("at", 1)).join(keyed.select("first").distinct(), "first", "left_semi")
    runs = F.array(*[F.when(F.size("at") >= n, word_key(F.col("at"), n)) for n in lengths])
    runs = written(starts.select("id", F.explode(F.array_compact(runs)).alias("key")).distinct(), "word-runs")

    shares = runs.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / key_rows).cast("int").alias("shares")).where("shares > 1")
    one = F.coalesce("shares", F.lit(1))
    dealt = runs.join(shares, "key", "left").select("id", "key", F.pmod(F.xxhash64("id"), one).cast("int").alias("share"))
    copies = keyed.join(shares, "key", "left").select("name", "key", F.explode(F.sequence(F.lit(0), one - 1)).alias("share"))
    return dealt.join(copies, ["key", "share"]).select("id", "name")


def named(names: DataFrame) -> DataFrame:
    """Distinct names without white space around them, and with a letter or digit."""
    return names.select(text.strip(F.col("name")).alias("name")).where(F.rlike("name", F.lit(WORDS))).distinct()


def mention_pairs(
    answers: DataFrame, names: DataFrame, key_words: int = KEY_WORDS, shard_chars: int = automaton.SHARD_CHARS
) -> DataFrame:
    """Pairs ``(id, name)`` where the answer holds the name as whole words.

    Names that are few enough meet the texts in an automaton, without a
    shuffle.  Others meet them by word runs, and the candidates of an answer
    then meet its text once, in one row.
    """
    usable = written(named(names), "names")
    shards = automaton.shards_for(usable, shard_chars)
    told = answers.select("id", "answer")
    if shards:
        found = automaton.with_found(told, "answer", usable, shards)
        return found.select("id", F.explode("found.name").alias("name"))
    wanted = candidates(told, usable, key_words).groupBy("id").agg(F.collect_set("name").alias("names"))
    met = told.join(wanted, "id")
    return met.select("id", F.explode(elements(F.filter("names", lambda n: whole_word(F.col("answer"), n)))).alias("name"))


def quoted(c: Column) -> Column:
    """A text as a regex that matches just this text."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def whole_word(answer: Column, name: Column) -> Column:
    return F.contains(answer, name) & F.rlike(answer, F.concat(F.lit(EDGE), quoted(name), F.lit(EDGE)))


def put_first(answer: Column, name: Column, link: Column) -> Column:
    """Write ``name (link)`` for the first whole-word occurrence of a name.

    Mostly that is the first occurrence of all; a pattern looks for a later one.
    """
    word = lambda sign: F.rlike(sign, F.lit(WORDS))
    tail = F.concat(F.lit(" ("), link, F.lit(")"))
    safe = F.regexp_replace(F.concat(name, tail), r"([\\$])", r"\\$1")
    pattern = F.concat(F.lit(r"(?s)\A(.*?)" + EDGE), quoted(name), F.lit(EDGE))

    def at_first(at: Column) -> Column:
        end = at + F.length(name)
        before = F.when(at > 1, F.substr(answer, at - 1, F.lit(1))).otherwise("")
        whole = (word(before) != word(F.left(name, F.lit(1)))) & (word(F.right(name, F.lit(1))) != word(F.substr(answer, end, F.lit(1))))
        put = F.concat(F.left(answer, end - 1), tail, F.substr(answer, end))
        return F.when(whole, put).otherwise(F.regexp_replace(answer, pattern, F.concat(F.lit("$1"), safe)))

    return text.once(F.position(name, answer), at_first)


def link_names(answers: DataFrame, names: DataFrame, files: DataFrame, shard_chars: int = automaton.SHARD_CHARS) -> DataFrame:
    """Answers with a link behind the first mention of each name, in table order.

    ``answers(id, answer)``, ``names(pos, name, file)``, ``files(file, link)``.
    A name that stands for several rows links the file of the first one.  A
    name is linked if the answer as it came holds it as whole words.
    """
    usable = names.select(F.col("pos").cast("long").alias("pos"), text.strip(F.col("name")).alias("name"), text.strip(F.col("file")).alias("file"))
    usable = usable.where(F.rlike("name", F.lit(WORDS)) & (F.col("file") != ""))
    usable = usable.groupBy("name").agg(F.min(F.struct("pos", "file")).alias("first")).select("name", "first.*")
    linked = written(link_or_name(usable, files).select("pos", "name", "link"), "linked-names")
    shards = automaton.shards_for(linked, shard_chars)
    if shards:
        joined = automaton.with_found(answers, "answer", linked, shards, "__links")
    else:
        pairs = candidates(answers, linked.select("name")).join(linked, "name")
        per_answer = pairs.groupBy("id").agg(F.collect_list(F.struct("pos", "name", "link")).alias("__links"))
        joined = answers.join(per_answer, "id", "left")
        joined = joined.withColumn("__links", F.filter("__links", lambda x: whole_word(F.col("answer"), x["name"])))
    folded = F.reduce(
        F.array_sort(F.coalesce("__links", F.array().cast("array<struct<pos:bigint,name:string,link:string>>"))),
        F.col("answer"),
        lambda acc, x: F.when(F.contains(acc, x["name"]), put_first(acc, x["name"], x["link"])).otherwise(acc),
    )
    return joined.withColumn("answer", folded).drop("__links")


def link_or_name(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``link``: the path of an existing file as a link, else its plain name."""
    known = files.select("file", F.col("link").alias("__link"))
    return (
        rows.join(known, "file", "left").withColumn("link", F.coalesce("__link", "file")).drop("__link")
    )


# a mention takes its run of signs up to the last suffix in it, so it can only
# start at the head of a run; saying so keeps the search linear
MENTION = r"(?iU)(?<![\w\s.-])" + FILE_MENTION


def raw_mentions(answer: Column) -> Column:
    low = F.lower(answer)
    maybe = F.contains(low, F.lit(".pdf")) | F.contains(low, F.lit(".doc"))
    return F.when(maybe, F.regexp_extract_all(answer, F.lit(MENTION), F.lit(1)))


def file_mentions(answers: DataFrame) -> DataFrame:
    """One row per mention of a document file: ``id, no, raw, mention`` (trimmed)."""
    rows = answers.select("id", F.posexplode(raw_mentions(F.col("answer"))).alias("no", "raw"))
    return rows.select(
        "id", (F.col("no") + 1).cast("long").alias("no"), "raw", text.strip(F.col("raw")).alias("mention")
    )


def resolved_mentions(answers: DataFrame, files: DataFrame) -> DataFrame:
    """Mentions with ``file``: the longest tail of the mention that names an existing file.

    The mention pattern also swallows the words before a file name, so each
    tail that starts at a word is tried, by an equi-join on the file name.
    Tails longer than the longest file name cannot match and are not built.
    The mentions go through the join with their tails, so the texts are read once.
    """
    longest = files.agg(F.coalesce(F.max(F.length("file")), F.lit(0)).alias("n")).scalar()
    pieces = F.split(F.right("mention", longest + 1), r"(?U)(?<=\s)(?=\S)")
    tails = F.transform(
        F.sequence(F.lit(1), F.size("__pieces")),
        lambda i: F.array_join(F.slice("__pieces", i, F.size("__pieces")), ""),
    )
    cut = file_mentions(answers).withColumn("__pieces", pieces)
    tried = cut.select("id", "no", "raw", "mention", F.explode(tails).alias("file"))
    known = files.select(F.col("file").alias("__file")).distinct()
    hits = tried.join(known, F.col("file") == F.col("__file"), "left")
    best = F.max(F.when(F.col("__file").isNotNull(), F.struct(F.length("file").alias("n"), "file")))["file"]
    return hits.groupBy("id", "no", "raw", "mention").agg(best.alias("file"))


def link_files(answers: DataFrame, files: DataFrame) -> DataFrame:
    """Answers with every mentioned existing file turned into its link; other text stays.

    The mentions are found once.  Each is a stretch of the answer that stands
    nowhere before its place, so going from one to the next finds the places.
    """
    linked = link_or_name(resolved_mentions(answers, files), files)
    before = F.substr("raw", F.lit(1), F.length("raw") - F.length("file"))
    new = F.coalesce(F.concat(before, F.col("link")), F.col("raw"))
    per_answer = linked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "raw", new.alias("new")))).alias("__new"))
    joined = answers.join(per_answer, "id", "left")

    def put(done: Column, x: Column) -> Column:
        at = F.position(x["raw"], done["rest"])
        return text.once(
            at,
            lambda at: F.struct(
                F.concat(done["told"], F.left(done["rest"], at - 1), x["new"]).alias("told"),
                F.substr(done["rest"], at + F.length(x["raw"])).alias("rest"),
            ),
        )

    start = F.struct(F.lit("").alias("told"), F.col("answer").alias("rest"))
    woven = F.reduce("__new", start, put, lambda done: F.concat(done["told"], done["rest"]))
    return joined.withColumn("answer", F.when(F.col("__new").isNull(), F.col("answer")).otherwise(woven)).drop("__new")
