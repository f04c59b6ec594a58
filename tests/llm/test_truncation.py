import random

from skyfold.llm.truncation import truncated, truncation_report

SUBJECTS = ["the night crew", "a visiting student", "the archive desk", "nobody at the station"]
VERBS = ["recorded three frames of the bright target", "filed the noisy spectrum under the wrong number", "kept the flat fields of the old season", "swapped both lamps before the second run"]
TAILS = ["within the errors", "weather permitting", "as noted by both referees"]


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    docs, cut = [], set()
    for i in range(n):
        text = " ".join(f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(TAILS)}." for _ in range(rng.randint(2, 6)))
        source = rng.choice(["limited", "free"])
        if source == "limited" and len(text) > 200:
            text = text[:200]
            if not text.rstrip().endswith("."):
                cut.add(i)
        elif rng.random() < 0.2:
            text = text[:-1]  # complete, without its last stop
        docs.append((i, text, source))
    return docs, cut


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, source string, ending string, n_chars int")


def test_cut_texts_are_told_from_whole_ones(spark):
    docs, cut = corpus()
    judged = truncated(frame(spark, docs)).persist()
    got = {r["doc_id"] for r in judged.where("is_truncated").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.03 * len(docs)
    rows = truncation_report(judged).collect()
    assert sum(r["texts"] for r in rows) == len(docs) and all(r["share"] == r["truncated_texts"] / r["texts"] for r in rows)


def test_odd_texts(spark):
    docs, _ = corpus(200)
    odd = [None, "", " \n\t", "." * 30, "{[", '{"a": 1}', '{"a": "b', "word", "…", "(see card 3", "[4]", "星が見えた。", "x" * 60000, "\ufffd", "!" * 60000 + "a", "a" + " " * 60000 + "b", "... " * 9000 + "c", "\"" * 50000 + "x", "a" + " b" * 30000 + "."]
    rows = docs + [(1000 + i, t, None) for i, t in enumerate(odd)] + [docs[0], docs[0]]
    got = {r["doc_id"]: r["is_truncated"] for r in truncated(frame(spark, rows)).collect()}
    assert 1000 not in got and 1001 not in got and 1002 not in got
    assert got[1005] is False and got[1006] is True and got[1011] is False
    assert truncated(frame(spark, [])).count() == 0


def test_cut_after_a_quoted_object_or_with_a_brace_in_a_string(spark):
    docs, _ = corpus(200)
    begun = f"{SUBJECTS[0].capitalize()} {VERBS[0][:-3]}"  # inside the last word
    odd = ['Seen: {"a": 1}. ' + begun, '{"a": "} ' + begun, 'Seen: {"a": 1}. ' + begun + "get within the errors.", 'Seen: {"a": 1}', '[{"a": 1}, {"b": 2}]']
    got = {r["doc_id"]: r["is_truncated"] for r in truncated(frame(spark, docs + [(1000 + i, t, "free") for i, t in enumerate(odd)])).collect()}
    assert [got[1000 + i] for i in range(5)] == [True, True, False, False, False]
