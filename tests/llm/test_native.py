import random
import re
from collections import Counter

import pytest

from gridmark.llm import license_scan, quality_rules
from gridmark.llm.oracles import ORACLES
from gridmark.llm.queries import QUERIES

from ..compare import assert_equal, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_equal(QUERIES[name](spark, SF), tables(SF), ORACLES[name])


def repeated(words, width=8):
    grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    many = Counter(grams)
    return len({j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + width)})


QUALITY = [
    "", None, "one two", " ".join(f"w{i}" for i in range(40)), "a b c d e f g h " * 3 + " ".join(f"w{i}" for i in range(90)),
    "He " * 300, "fine line of many different words that go on and on without end here now then\n" * 2, "\n\n \n", "x" * 200_000 + " y" * 5000,
    "Home » News » Sport » Weather\n" + " ".join(f"word{i}" for i in range(60)), "we use cookies here\n" + " ".join(f"word{i}" for i in range(60)),
    " ".join(f"w{i}***" for i in range(50)), "STOP!! " * 30, " ".join(f"a{i} |" for i in range(40)),
]


def test_quality_figures(spark):
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate([*QUALITY, *QUALITY])], "doc_id long, text string, kept boolean")
    rows = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert len(rows) == 2 * len(QUALITY)
    for i, text in enumerate([*QUALITY, *QUALITY]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        full = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(full) - len(set(full)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or "")) and r["n_repeat_words"] == repeated(words)
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words))
    assert [rows[i]["kept"] for i in (3, 9, 10)] == [True] * 3 and not any(rows[i]["kept"] for i in (0, 1, 5, 11, 12, 13))
    assert rows[9]["cleaned"].startswith("word0") and rows[10]["cleaned"].startswith("word0")
    assert rows[3]["cleaned"] == QUALITY[3]
    assert quality_rules.judge(df.limit(0)).count() == 0


def plain_lines(text):
    """The lines that pass, by the docstring's rules, line by line."""
    kinds, lines = [], text.split("\n")
    for line in lines:
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        marks = max(len(re.findall(r"[#*$%&|<>]", line)), len(re.findall(r"!!+|\?\?+", line)))
        furniture = any(p in line.lower() for p in quality_rules.BOILERPLATE) or len(re.findall("[»›•·]", line)) >= 2
        again = sum(a == b for a, b in zip(w, w[1:]))
        if not w:
            kinds.append("blank")
        elif marks >= 0.3 * len(w) or (len(w) <= 25 and furniture) or (len(w) >= 8 and again >= 0.3 * len(w)):
            kinds.append("failed")
        elif len(w) > 25 or line.rstrip(" \t\n\x0b\x0c\r").rstrip("\"'”’»)]）」』")[-1:] in tuple(".!?…:;。！？：；।؟۔") or re.search("[\u0e00-\u109f\u1780-\u17ff]", line):
            kinds.append("closed")
        else:
            kinds.append("item" if len(w) <= 3 else "open")
    n_open = sum(k in ("item", "open") for k in kinds)
    crowd = n_open >= 5 and 2 * n_open >= sum(k != "blank" for k in kinds)
    out = []
    for i, (line, kind) in enumerate(zip(lines, kinds)):
        a = b = i
        while kind == "item" and a > 0 and kinds[a - 1] == "item":
            a -= 1
        while kind == "item" and b + 1 < len(kinds) and kinds[b + 1] == "item":
            b += 1
        if kind != "failed" and not (crowd and kind in ("item", "open")) and not (kind == "item" and b - a >= 3):
            out.append(line)
    return out


def test_lines_by_their_company(spark):
    article = "\n".join(f"Sentence {i} of the article says this and that about the matter at hand." for i in range(12))
    menu = "\n".join(["Home", "News", "Sport", "About us"])
    thai = "\n".join(["สวัสดี ชาวโลก"] * 3 + [f"ข้อความ ที่ {i}" for i in range(20)])
    listing = "\n".join(f"item number {i} of a long list" for i in range(30))
    named = [f"Heading\n{article}", f"{menu}\n{article}", f"Home\nNews\n\nSport\nAbout us\n{article}", thai, listing, f"Title\n\nBy line\n{article}\nHe said \"so.\"\nend (of it.)  "]
    rng = random.Random(3)
    pieces = ["Home", "About us", "A sentence that ends.", "an open line of words", "", "a » b » c", "x" * 40, "word " * 30, "End.”", "ok!", "** ** **", "ไทย ไทย", "end.\u2028", "end. \t\r", "no no no no no no no no"]
    texts = named + ["\n".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["cleaned"] for r in quality_rules.judge(df).collect()}
    assert [out[i] for i in range(6)] == [named[0], article, named[2], thai, "", named[5]]
    for i, text in enumerate(texts):
        assert out[i] == "\n".join(plain_lines(text)), text


def test_lines_of_any_length_and_clashing_names(spark):
    nav = "Home » News » " + " ".join(["Sport"] * 4 + ["W" * 90] * 4)
    long_nav = nav.replace("W" * 90, "W" * 400)
    body = "\n".join(" ".join(f"word{i}x{j}" for i in range(12)) for j in range(4))
    rows = [(1, f"{nav}\n{body}", 1, "a"), (2, f"{long_nav}\n{body}", 1, "a"), (3, " ".join(f"v{i % 90_000}" for i in range(300_000)), 1, "a"), (4, " ".join(f"v{i}" for i in range(250_000)) + " end" * 30, 1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, facts int, _facts string")
    out = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert all(out[k]["cleaned"] == body and out[k]["facts"] == 1 and out[k]["_facts"] == "a" for k in (1, 2))
    assert out[1]["lost_share"] == len(nav) / len(rows[0][1]) and out[2]["lost_share"] == len(long_nav) / len(rows[1][1])
    assert out[3]["n_repeat_words"] == 300_000 and out[3]["base_failed"] and out[4]["n_repeat_words"] == 30
    plan = quality_rules.judge(df).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count(lambda") + plan.count("regexp_count(namedlambdavariable(), [^\\x20") <= 2  # facts aren't computed by the filter again


LICENSES = [
    None, "", "Released under the MIT License.", "under the\nMIT\n\nlicense under the mit license", "Apache License, Version 2.0", "apache license version 3",
    "cc-by-nc " * 3, "word " * 5000 + "cc by nc", "é" * 50 + " under the MIT license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met",
    "the license of mit under", "xcc by nc",
]


def test_license_places(spark):
    rows = [(i if i % 3 else None, t, "x") for i, t in enumerate(LICENSES)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    out = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in license_scan.scan(df).collect())
    want = []
    for doc, text, _ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places, labels = [], set()
        for t in license_scan.PHRASES:
            at = [i for i in range(len(words)) if tuple(words[i : i + len(t.words)]) == t.words]
            places += at
            labels |= {t.label} if at else set()
        notices = {t.label for t in license_scan.NOTICES + license_scan.LICENSES if len(words) < 84 and len(set(t.words) & set(words)) >= t.threshold * len(set(t.words))}
        want.append((doc is None, doc or 0, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | notices))))
    assert out == sorted(want)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_notice_of_the_method(spark):
    df = spark.createDataFrame([(1, LICENSES[9])], "doc_id long, text string")
    r = license_scan.scan(df).first()
    assert (r["base_labels"], r["labels"]) == ("", "bsd") and 0.8 <= r["score"] < 1


def test_whole_licenses_in_long_texts_and_clashing_names(spark):
    filler = " ".join(f"f{i}" for i in range(9000))
    mit = " ".join(license_scan.LICENSES[0].words).upper()
    rows = [(1, f"{filler} {mit} {filler}", 1, "k"), (2, mit, 1, "k"), (3, f"{filler} under the MIT license {filler} cc by nc", 1, "k"), (4, None, 1, "k"), (1, "other", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key int, digest string")
    out = {(r["doc_id"], r["text"]): r for r in license_scan.scan(df).collect()}
    assert set(license_scan.scan(df).columns) >= {"_key", "digest", "text"} and all(r["_key"] == 1 and r["digest"] == "k" for r in out.values())
    assert [out[k[:2]]["labels"] for k in rows] == ["mit", "mit", "cc-by-nc,mit", "", ""]
    assert out[rows[0][:2]]["score"] == 1.0 and (out[rows[2][:2]]["first_word"], out[rows[2][:2]]["last_word"]) == (9000, 18004)


def test_filters_reject_and_lose_nothing(spark):
    rng = random.Random(8)
    templates = license_scan.TEMPLATES
    vocabulary = sorted({w for t in templates for w in t.words})
    texts = []
    for n in range(120):
        t = rng.choice(templates)
        words = [w for w in t.words if rng.random() < rng.choice([0.5, 0.8, 0.9, 1.0])] + rng.choices(vocabulary, k=rng.randint(0, 12)) + [f"x{rng.randint(0, 50)}" for _ in range(rng.randint(0, 60))]
        texts.append(" ".join(words if n % 2 else rng.sample(words, len(words))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = license_scan.frequencies(df, "text", vocabulary)
    assert count == {w: n for w in vocabulary if (n := sum(w in t.split() for t in texts))}
    want = set()
    for doc, text in enumerate(texts):
        words = text.split()
        for longest, members in license_scan.classes(templates).items():
            for at in range(0, len(words), longest):
                block = set(words[at : at + 2 * longest])
                want |= {(doc, at, k) for k in members if len(block & set(templates[k].words)) >= templates[k].threshold * len(set(templates[k].words)) - 1e-9}
    near = {(r["doc"], r["start"], r["template"]) for r in license_scan.candidates(df, templates, count).select("doc", "start", "template").collect()}
    assert want <= near
    ranked, table = license_scan.prefixes(templates, count)
    unfiltered, unplaced = set(), set()
    for doc, text in enumerate(texts):
        words = text.split()
        for longest, word, k, place, _, alpha, *_ in table:
            for at in range(0, len(words), longest):
                own = [w for w in ranked if w in words[at : at + 2 * longest]]
                if word in own:
                    unfiltered.add((doc, at, k))
                    if len(own) >= alpha:
                        unplaced.add((doc, at, k))
    assert near < unplaced < unfiltered  # the length filter rejects, and the positional filter rejects more


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_license_scan"])
def test_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
