import tracemalloc

from pyspark.sql import functions as F

from docintake.plans.records import LengthClient
from docintake.sources import model


class CountingClient:
    """Answers with how many blocks it was asked about, and fails once for a text with ``!``."""

    def __init__(self):
        self.asked = 0
        self.last = None

    def generate_content(self, parts):
        self.asked += 1
        again, self.last = parts[1] == self.last, parts[1]
        if "!" in parts[1] and not again:
            raise ValueError("not yet")
        return f'{{"ten": "{self.asked}"}}'


def test_length_client_remembers_one_text():
    client, answers = LengthClient(), {}
    tracemalloc.start()
    for n in range(2_000):
        document = f"{n:04d}" + "x" * (5_000 + n % 2)
        answers[n] = [client.generate_content(["", document]) for _ in range(2)]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    # the texts are 10 MB
    assert held < 2_000_000
    assert answers[0] == ['Sure: {"ten": "N5004"}'] * 2
    assert answers[1] == ["{broken", 'Sure: {"ten": "N5005"}']


def test_blocks_are_asked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(model, "BLOCKS_AT_ONCE", 3)
    texts = [(n, f"text {n}" + "!" * (n % 5 == 0)) for n in range(10)] + [(None, "x" * 8_001), (11, " "), (12, None)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in model.ask(rows, CountingClient).collect()]
    wanted, asked = [], 0
    for doc_id, block, text in [(n, 0, t) for n, t in texts[:10]] + [(None, 0, ""), (None, 1, "")]:
        asked += 1
        if "!" in text:
            wanted.append((doc_id, block, 1, None, "ValueError: not yet"))
            asked += 1
        wanted.append((doc_id, block, 1 + ("!" in text), f'{{"ten": "{asked}"}}', None))
    assert got == wanted


def test_answers_meet_their_documents(spark, tmp_path):
    texts = [(n % 40, "y" * (n % 40 + 1)) for n in range(80)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").dropDuplicates(["doc_id"])
    found = model.extract_with(rows, LengthClient, str(tmp_path / "responses")).select("doc_id", F.col("info.ten").alias("ten"))
    assert {tuple(r) for r in found.collect()} == {(n, f"N{n + 1}") for n in range(40)}
