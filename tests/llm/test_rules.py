import re
from collections import Counter

import pytest

from lakeaudit.llm import rules

TEXTS = [
    None, "", " \t\n\x0b\f\r", "one", "a b", "a b c", "a b c a b c", "x x x x", "a b c\nd a b c\n\nd a b c", "é ü # $%&|<>* ñ\n- item\n* item\n• item\nend...\nend…  \nfin.", "l1\nl1\n \nl1\r\nl1\r",
    "the of and to " * 30, "word " * 49, "w1 the " * 60, " nb sp the\u0085x", "🙂🙂 # 🙂", " ".join(f"w{i % 7}" for i in range(3000)), " ".join(f"the{i} of and" for i in range(40000)),
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_stop_words": sum(w.lower() in rules.STOP_WORDS for w in words), "n_lines": len(lines), "n_bullet_lines": sum(bool(re.match(r"[ \t\r]*[-*•]", x)) for x in lines), "n_ellipsis_lines": sum(x.rstrip(" \t\r").endswith(("...", "…")) for x in lines),
    }
    bad = [r.name for r in rules.TABLE if ((100 * m[r.measure] - r.percent * m[r.base] if r.base else m[r.measure] - r.percent) * (1 if r.sign == ">" else -1)) > 0]
    return m | {"base_failed": m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"], "failed_rules": bad, "kept": not bad}


@pytest.mark.parametrize("place", [24, 3, 61])
def test_brute_force(spark, monkeypatch, place):
    """Few places: the texts are sorted; few bits of hash: different triples meet in one."""
    monkeypatch.setattr(rules, "PLACE", place)
    rows = [(i, t) for i, t in enumerate([*TEXTS[:-1], TEXTS[-1] if place == 24 else "x y z"])]
    got = {r["doc_id"]: r.asDict() for r in rules.judge(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {i: {"doc_id": i, "text": t} | plain(t) for i, t in rows}


def test_other_tables_names_and_repeats(spark):
    rows = [(1, "a b c", 7, "x"), (1, "a b c", 7, "x"), (None, "a b", 8, None)]
    df = spark.createDataFrame(rows, "`__t` int, text string, n_words int, `kept` string")
    out = rules.judge(df, [rules.Rule("long", "n_words", ">", 2)]).collect()
    assert sorted((r["__t"] or 0, r["n_words"], r["failed_rules"], r["base_failed"], r["kept"]) for r in out) == [(0, 2, [], True, False), (1, 3, ["long"], True, False), (1, 3, ["long"], True, False)]
    assert rules.judge(df.limit(0)).count() == 0 and len(set(out[0].asDict())) == len(out[0])
