import random
import re

import pytest
from pyspark.sql import functions as F

from docintake.functions import answers
from docintake.operators import automaton, mentions


def infos(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, answer string")
    got = answers.with_answer_info(rows, "answer").orderBy("i").collect()
    return [r["info"] and r["info"].asDict() for r in got]


def test_object_from_answer(spark):
    got = infos(
        spark,
        [
            'Sure\n```json\n{"ten": "A"}\n``` bye',
            'text {"ten": "B"} text',
            '{"ten": 1} and {"ten": 2}',
            '```json\n{broken}\n``` {"ten": "C"}',
            "[1]",
            "{}",
            "{ }",
            "none",
            "",
            '{"tuoi": 30, "ky_nang": ["a","b"], "email": null, "other": 1}',
            "{'ten': 'x'}",
            '{"ten": "A"}} x {"ten": "B"}',
            '{"ten": "A"},"seal":"1"} {"ten": "B"}',
            '{"other": 1}',
            '```\n{"ten": "fence without a name"}\n```',
            'so {"ten": "A"}, "notes": {"x": 1}',
        ],
    )
    assert [g and g["ten"] for g in got] == [
        "A", "B", None, None, None, None, None, None, None, None, None, None, None, None, "fence without a name", None,
    ]
    assert got[9]["tuoi"] == "30"
    assert got[9]["ky_nang"] == '["a","b"]'
    assert got[9]["email"] is None
    assert got[13] is not None
    assert [g is None for g in got[2:9]] == [True] * 7
    assert got[10] is None and got[11] is None and got[12] is None


def test_array_from_answer(spark):
    texts = ['```json\n["a", "b"]\n```', '["a", null]', "[]", "no json", '{"a": 1}', '["a"] tail', '["a"], "x": ["b"]']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, answer string")
    got = answers.with_answer_array(rows, "answer", "x").orderBy("i").collect()
    assert [r["x"] for r in got] == [["a", "b"], ["a"], [], None, None, None, None]


def python_layout(answer):
    answer = re.sub(r"\n\s*\n\s*\n", "\n\n", answer).strip()
    answer = re.sub(r"^(#{1,6})\s*(.+)", r"\1 \2", answer, flags=re.MULTILINE)
    return re.sub(r"^\s*[-*+]\s*", "• ", answer, flags=re.MULTILINE)


def test_layout(spark):
    texts = [
        "##X y\n\n\n\n- a\n  * b\n+c",
        "  \u00a0a\n \n\t\n\u00a0\nb  ",
        "####### seven",
        "-\u00a0x\n\n-y\n",
        "# \n\n\ntext",
        "a\r\n- b\u2028- c",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, answer string")
    got = rows.select("i", answers.tidy_layout(F.col("answer")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [python_layout(t) for t in texts]
    assert got[0]["x"] == "## X y\n• a\n• b\n• c"


def test_mood(spark):
    pad = "x" * 50
    texts = ["TÌM THẤY " + pad, "không " + pad, "không có " + pad, "có", "😀 có " + pad, pad + "y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, answer string")
    got = answers.clean_answers(rows).orderBy("i").collect()
    assert [r["answer"][:2] for r in got] == ["✅ ", "ℹ️", "✅ ", "có", "😀 ", "xx"]


NAMES = "pos int, name string, file string"


def linked(spark, told, names, files):
    answers_ = spark.createDataFrame(list(enumerate(told)), "id int, answer string")
    names_ = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], NAMES)
    files_ = spark.createDataFrame([(f, f"<{f}>") for f in files], "file string, link string")
    got = mentions.link_names(answers_, names_, files_).orderBy("id").collect()
    return [r["answer"] for r in got]


def test_name_links(spark):
    got = linked(
        spark,
        ["Miên biết lưu trữ.", "Miênxx, then Miên and Miên", "Brask", "nobody", "Đỗ Hà An, Đỗ Hà Anh"],
        [("Miên", "mien.pdf"), (" ", "x.pdf"), ("Brask", "b$1\\.pdf"), ("Đỗ Hà An", "an.pdf"), ("Hà", " "), ("Miên", "later.pdf")],
        ["mien.pdf"],
    )
    assert got == [
        "Miên (<mien.pdf>) biết lưu trữ.",
        "Miênxx, then Miên (<mien.pdf>) and Miên",
        "Brask (b$1\\.pdf)",
        "nobody",
        "Đỗ Hà An (an.pdf), Đỗ Hà Anh",
    ]


def test_long_names_and_signs(spark):
    name = "A-B. C's (x) and very much longer than four words"
    got = linked(spark, [f"see {name}!", "see A-B. C's (x) and"], [(name, "n.pdf")], [])
    assert got == [f"see {name} (n.pdf)!", "see A-B. C's (x) and"]


def test_mention_pairs_equal_brute_force(spark):
    words = ["an", "bo", "cy", "an bo", "bo cy an", "cy cy", "an bo cy an bo", "Bo"]
    told = [" ".join(words[(i * 7 + j * j) % 5] for j in range(12)) + ("." if i % 2 else "-bo!") for i in range(30)]
    answers_ = spark.createDataFrame(list(enumerate(told)), "id int, answer string")
    names_ = spark.createDataFrame([(w,) for w in words], "name string")
    got = {(r["id"], r["name"]) for r in mentions.mention_pairs(answers_, names_).collect()}
    brute = {(i, w) for i, t in enumerate(told) for w in words if re.search(rf"\b{re.escape(w)}\b", t)}
    assert got == brute and len(brute) > 50


def told_and_names():
    r = random.Random(8)
    words = ["an", "bo", "cy", "Bo", "été", "x_1", "漢字", "7"]
    names = {" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(60)} | {"an-bo", "(cy)", "cy.", "...", "", " an "}
    told = ["".join(r.choice([*words, " ", " ", " ", "-", ". ", "(cy)"]) + " " * r.randint(0, 1) for _ in range(25)) for _ in range(120)]
    return told + [None, "", "an"], sorted(names)


@pytest.mark.parametrize("shard_chars", [1_000_000, 600, 1])
def test_automaton_shards_and_join_equal_brute_force(spark, shard_chars):
    told, names = told_and_names()
    answers_ = spark.createDataFrame(list(enumerate(told)), "id int, answer string")
    names_ = spark.createDataFrame([(n,) for n in names], "name string")
    shards = automaton.shards_for(mentions.named(names_), shard_chars)
    assert shards == 1 if shard_chars > 600 else shards is None if shard_chars == 1 else 1 < shards <= automaton.MOST_SHARDS
    got = sorted(map(tuple, mentions.mention_pairs(answers_, names_, shard_chars=shard_chars).collect()))
    usable = {n.strip() for n in names if re.search(r"\w", n)}
    assert got == sorted((i, n) for i, t in enumerate(told) for n in usable if t and re.search(rf"\b{re.escape(n)}\b", t))


@pytest.mark.parametrize("shard_chars", [1_000_000, 1])
def test_name_links_equal_brute_force(spark, shard_chars):
    told, names = told_and_names()
    rows = [(n, name, f"f{n}.pdf") for n, name in enumerate(names)]
    files_ = spark.createDataFrame([(f"f{n}.pdf", f"<an {n}>") for n in range(0, 40, 3)], "file string, link string")
    answers_ = spark.createDataFrame(list(enumerate(told)), "id int, answer string")
    names_ = spark.createDataFrame(rows, NAMES)
    got = {r["id"]: r["answer"] for r in mentions.link_names(answers_, names_, files_, shard_chars=shard_chars).collect()}
    first = {}
    for n, name, file in rows:
        if re.search(r"\w", name):
            first.setdefault(name.strip(), f"<an {n}>" if n < 40 and n % 3 == 0 else file)
    for i, t in enumerate(told):
        want = t
        for name, link in first.items():
            pattern = rf"\b{re.escape(name)}\b"
            if t and re.search(pattern, t):
                want = re.sub(pattern, lambda m, link=link: f"{m[0]} ({link})", want, count=1)
        assert got[i] == want


def test_common_words_are_dealt(spark):
    answers_ = spark.range(300).select("id", F.lit("the an of the").alias("answer"))
    names_ = spark.createDataFrame([("the",), ("of the",), ("an of x",)], "name string")
    got = mentions.candidates(answers_, names_, key_rows=7)
    assert sorted(map(tuple, got.collect())) == sorted((i, n) for i in range(300) for n in ("the", "of the"))
    assert mentions.candidates(answers_, names_.limit(0)).collect() == []


def test_file_links(spark):
    told = ["see the cv 1.pdf, b  c.DOCX, and x.pdf y.pdf", "cv 1.pdfx", "none", "é.pdf\ncv 1.pdf", "of 1.pdf z.pdf, 1.pdf"]
    answers_ = spark.createDataFrame(list(enumerate(told)), "id int, answer string")
    files = spark.createDataFrame(
        [("1.pdf", "<1>"), ("cv 1.pdf", "<cv 1>"), ("b  c.DOCX", "<bc>"), ("y.pdf", "<y>")], "file string, link string"
    )
    got = mentions.link_files(answers_, files).orderBy("id").collect()
    assert [r["answer"] for r in got] == [
        "see the <cv 1>, <bc>, and x.pdf <y>",
        "<cv 1>x",
        "none",
        "é.pdf\n<cv 1>",
        "of 1.pdf z.pdf, <1>",
    ]
