import random

import pytest

from spanframe.llm import subjects as S

WORDS = {"law": ["court", "judge", "trial", "verdict", "lawyer"], "sport": ["match", "goal", "coach", "stadium", "trophy"]}
GENERAL = ["house", "city", "river", "morning", "friend", "street", "window", "teacher"]


def sentence(rng, subject):
    words = rng.sample(GENERAL, 3) + (rng.sample(WORDS[subject], 2) if subject != "none" else rng.sample(GENERAL, 2))
    rng.shuffle(words)
    return " ".join(words).capitalize() + "."


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        subject = ("law", "sport", "none")[i % 3]
        rows.append((i, "Home | News\n" + "\n".join(sentence(rng, subject) for _ in range(6)), subject))
    return rows


def test_fit_and_assign(spark):
    rows = corpus(1, 120)
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows] + [(500, None, "c"), (501, "", "c"), (502, " \n ", "c"), (503, "Home | News", "c")], "doc_id long, text string, subject string")
    labels = spark.createDataFrame([(i, s, "e") for i, _, s in rows[:60]] + [(1, "sport", "e"), (None, "law", "e"), (2, None, "e")], "doc_id long, subject string, labeller string")
    model = S.fit(docs, labels)
    assert model.share == S.DEFAULT_SHARE and S.line_code("home | news") in model.menu
    found = {}
    for r in S.assign(docs, model).collect():
        found.setdefault(r["doc_id"], []).append(r["subject"])
    truth = {i: [s] for i, _, s in rows if s != "none"}
    wrong = [i for i in range(120) if found.get(i, []) != truth.get(i, [])]
    assert len(wrong) <= 3 and not set(found) & {500, 501, 502, 503}
    assert S.assign(docs.limit(0), model).count() == 0


def test_documents_of_two_subjects_are_mined(spark):
    df = spark.createDataFrame([(["law", "sport"], "The court sat. A goal"), (["law"], "A trial"), (["none"], None)], "subjects array<string>, text string")
    found = sorted((r["subject"], list(r["stems"])) for r in S._transactions(df, frozenset()).collect())
    assert found == [("law", ["a", "goal"]), ("law", ["a", "trial"]), ("law", ["court", "sat", "the"]), ("sport", ["a", "goal"]), ("sport", ["court", "sat", "the"])]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c.")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, subject string, labeller string")
    model = S.fit(docs, labels)
    assert model.rules == {} and S.assign(docs, model).count() == 0


def test_running_text_and_shares():
    model = S.Model({("court",): ("law", 2.0), ("match",): ("sport", 2.0), ("city", "match"): ("law", 9.0)}, frozenset({S.line_code("menu line")}))
    assert S.running_text("Menu line\n«Court quoted here»\nThe court sat. Then lunch", model.menu) == [["the", "court", "sat"], ["then", "lunch"]]
    assert model.shares("The court sat. Then long lunch") == {"law": 0.5}
    assert model.shares("match match court") == {"sport": 1.0} or model.shares("match match court") == {"law": 1.0}
    assert model.shares("city match") == {"law": 1.0}
    assert model.shares(None) == {} and model.shares("!!!") == {}
    foreign = "The court sat in the big house near the river today.\nThe court sat in the big house near the river again.\nКездесуде матч болды және бәрі қуанды деп хабарлады."
    assert all("матч" not in w for w in S.running_text(foreign, frozenset()))


def test_stems_of_romanised_words():
    assert S.stem("заңды") == S.stem("zangdy") == "zangdy" and S.stem("") == ""


def test_pruning_keeps_only_surer_rules(spark):
    rows = [("law", ["court", "x"])] * 30 + [("sport", ["match", "x"])] * 30 + [("law", ["match", "court"])] * 10
    rules = S.mine_rules(spark.createDataFrame(rows, "subject string, stems array<string>"))
    assert rules[("court",)][0] == "law" and ("court", "x") not in rules
    assert rules[("court", "match")][0] == "law" if ("court", "match") in rules else rules[("court",)][1] > 3


def test_copies_of_a_text_are_no_menu(spark):
    rng = random.Random(3)
    copied = "Home | News\n" + "\n".join(f"{sentence(rng, 'law')} Paragraph {i}" for i in range(4))
    rows = [(i, copied) for i in range(40)] + [(100 + i, f"  Home | News\nHome | News\n{sentence(rng, 'sport')} Text {i}") for i in range(80)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert S.menu_lines(docs) == {S.line_code("home | news")}
    # a line twice in one text counts once
    few = spark.createDataFrame([(i, f"  Twice\nTwice\nText {i}") for i in range(4)], "doc_id long, text string")
    assert S.menu_lines(few) == frozenset()


def test_menu_lines_of_any_length_and_form(spark, monkeypatch):
    long = "Бас бет · " * 60
    docs = spark.createDataFrame([(i, f"{long if i % 2 else long.upper()}\xa0\n\u200bЙ\nText {i}") for i in range(8)], "doc_id long, text string")
    assert S.menu_lines(docs) == {S.line_code(long.lower().strip()), S.line_code("й")}
    assert S.running_text(f" {long}\nThe text", S.menu_lines(docs)) == [["the", "text"]]
    monkeypatch.setattr(S, "MOST_MENU", 1)
    with pytest.raises(ValueError, match="recur"):
        S.menu_lines(docs)


def test_long_units_are_scored_in_windows():
    model = S.Model({("court",): ("law", 2.0), ("match",): ("sport", 2.0)}, frozenset())
    words = ["court", "house", "river"] * 200 + ["match", "house", "river"] * 200
    assert model.shares(" ".join(words)) == {"law": 0.5, "sport": 0.5}
    for n in (1, 30, 31, 59, 61, 1000):
        units = S.running_text(" ".join(str(i) for i in range(n)), frozenset())
        assert [w for u in units for w in u] == [str(i) for i in range(n)]
        assert max(map(len, units)) <= S.LONGEST_UNIT and max(map(len, units)) - min(map(len, units)) <= 1


def test_only_the_quoted_span_is_dropped():
    text = lambda s: [w for u in S.running_text(s, frozenset()) for w in u]
    assert text("«Court sat»; the match went on") == ["the", "match", "went", "on"]
    assert text('We saw "a court" and “a judge” and „a trial“ there') == ["we", "saw", "and", "and", "there"]
    assert text("a «b «c» d» e «f» g") == ["a", "e", "g"] and text("a „b “c” d” e") == ["a", "e"]
    assert text('a 12" screen and a 15" one') == ["a", "12", "screen", "and", "a", "15", "one"] and text("a » b « c") == ["a", "b", "c"]
    assert text("> cited line") == text("«cited without an end") == text("«cited»") == []
    model = S.Model({("court",): ("law", 2.0), ("match",): ("sport", 2.0)}, frozenset())
    assert model.shares("«The court sat»; the match went on") == {"sport": 1.0}
    assert len(text("«" * 50_000 + "a" + "”»" * 50_000)) == 0


def test_only_long_units_are_cut(monkeypatch):
    cut, whole = [], S.windows
    monkeypatch.setattr(S, "windows", lambda words: cut.append(len(words)) or whole(words))
    long = " ".join(f"w{i}" for i in range(S.LONGEST_UNIT + 1))
    units = S.running_text(f"One two. Three!\n{long}. ...\nFour", frozenset())
    assert cut == [S.LONGEST_UNIT + 1] and [len(u) for u in units] == [2, 1, 15, 16, 1]
