import re
import unicodedata
import os.path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docintake.fixed_values import INFO_KEYS, PREFIX_RULES
from docintake.functions import text
from docintake.operators import chat

C = F.col("c")

VIETNAMESE = """Họ tên: Lý Thu Miên
Tuổi: 41
Email: mien.ly@mail.invalid
Điện thoại: +84 123 000 777
Địa chỉ: 8 ngõ Trúc
Vị trí: Thủ thư
Học vấn: Trường Đêm
Kinh nghiệm: 12 năm
Kỹ năng: lưu trữ"""

ENGLISH = """Họ tên: Ottoline Brask
Age: 58
Email: otto@brask.invalid
Điện thoại: 0900-111-2223
Address: 77 Quay Lane
Position: Pilot
Education: Night school
Experience: two harbours
Skills: knots"""


def test_nine_fields(column):
    first, second = column([VIETNAMESE, ENGLISH], text.extract_info(C))
    values = ["Lý Thu Miên", "41", "mien.ly@mail.invalid", "+84 123 000 777", "Thủ thư", "Trường Đêm", "12 năm", "8 ngõ Trúc", "lưu trữ"]
    assert first.asDict() == dict(zip(INFO_KEYS, values, strict=True))
    values = ["Ottoline Brask", "58", "otto@brask.invalid", "0900-111-2223", "Pilot", "Night school", "two harbours", "77 Quay Lane", "knots"]
    assert second.asDict() == dict(zip(INFO_KEYS, values, strict=True))


def test_field_edges(column):
    got = column(
        ["HỌ TÊN: X", "Tên:\u00a0X ", "nothing", "Tên:\n\n next line", "K\u0130NH NGH\u0130\u1ec6M - 2", "s\u212aill: x", "Tên không. Tên: Y"],
        text.extract_info(C),
    )
    assert [r["ten"] for r in got] == ["X", "X", "", "next line", "", "", "không. Tên: Y"]
    assert got[5]["ky_nang"] == "x"


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="Tênskilả gAGE:- \n\u00a0İſ@.a1+-x9", max_size=60), min_size=20, max_size=40))
def test_fields_equal_a_plain_search(column, texts):
    """Starting at the first label, and the linear e-mail form, change no result."""
    label = lambda f: text.label_pattern(f)
    patterns = {
        "ten": label("ten"),
        "tuoi": label("tuoi"),
        "ky_nang": label("ky_nang"),
        "email": r"([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)",
        "dien_thoai": r"(\+?\d[\d\-\s]{7,}\d)",
    }
    plain = F.struct(
        *[F.coalesce(text.strip(F.regexp_extract(C, f"(?iU){p}", 1)), F.lit("")).alias(f) for f, p in patterns.items()]
    )
    fast = F.struct(*[text.extract_field(C, f).alias(f) for f in patterns])
    assert column(texts, fast) == column(texts, plain)


def test_truncate(column):
    got = column(["x" * 8000, "y" * 8001], text.truncate(C))
    assert got == ["x" * 8000, "y" * 8000 + "...[text truncated]"]


def test_strip_and_blank(column):
    values = ["\u3000 a\u00a0b\t\n", "\x1c\u2028", "", None]
    assert column(values, text.strip(C)) == ["a\u00a0b", "", "", None]
    assert column(values, text.is_blank(C)) == [False, True, True, True]


NAMES = ["Hồ sơ (cv) #1.pdf", "a.b.DOCX", "x_y-z.pdf", unicodedata.normalize("NFD", "ê") + ".pdf", ".bashrc", "a.", "..x", "no", "d.e/f", "/p/q.r/s.t"]


def test_path_parts_equal_the_standard_library(column):
    assert column(NAMES, text.stem(C)) == [os.path.splitext(os.path.basename(n))[0] for n in NAMES]
    assert column(NAMES, text.suffix(C)) == [os.path.splitext(n)[1].lower() for n in NAMES]
    assert column(NAMES, text.base_name(C)) == [os.path.basename(n) for n in NAMES]


def test_sanitize(column):
    plain = [n for n in NAMES if "/" not in n]
    expected = [re.sub(r"[^\w\-\_ ]", "_", os.path.splitext(n)[0]) + os.path.splitext(n)[1] for n in plain]
    assert column(plain, text.sanitize_name(C)) == expected
    assert expected[0] == "Hồ sơ _cv_ _1.pdf"


def test_obvious_names(column):
    values = ["My CV.pdf", "RESUME.docx", "profile.pdf", "a.cv", "Vitae-1.pdf"]
    assert column(values, text.obvious_name(C)) == [True, True, False, False, True]


def test_size(column):
    expected = [f"{n / 1024:.1f} KB" for n in (0, 1280, 1331, 1024, 5_000_000)]
    assert column([0, 1280, 1331, 1024, 5_000_000], text.size_text(C), "long") == expected


def test_prefix_rules(column):
    values = [" sk-or-123", "OR-x", "AIzaSy", "vs-1", "VectorShift9", "x", ""]
    assert column(values, text.first_prefix(C, PREFIX_RULES)) == [
        "openrouter", "openrouter", "google", "vectorshift", "vectorshift", None, None,
    ]


@pytest.mark.parametrize(
    ("question", "kind"),
    [
        ("TÌM ứng viên", "search"),
        ("my account", "statistics"),
        ("So sánh A và B", "comparison"),
        ("overview", "summary"),
        ("Kỹ năng?", "skills"),
        ("công việc", "experience"),
        ("bằng cấp", "education"),
        ("xin chào", "general"),
        ("find and count", "search"),
    ],
)
def test_question_classes(column, question, kind):
    assert column([question], chat.question_class(C)) == [kind]


def test_errors(column):
    values = ["HTTP 429", "Quota exceeded", "rate limit", "RESOURCE_EXHAUSTED", "boom", None]
    assert column(values, text.error_class(C)) == ["quota"] * 4 + ["other", None]
    assert column(values, text.retry_delay(C, F.lit(2), 3)) == [4, 4, 4, 4, 0, None]
    assert column(values, text.retry_delay(C, F.lit(3), 3)) == [None] * 6
