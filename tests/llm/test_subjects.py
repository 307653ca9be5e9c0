import random

from lodestone.llm import subjects

TERMS = {"sport": "javelin halftime referee marathon stadium relay".split(), "law": "tribunal notary verdict statute witness appeal".split(), "music": "sonata violin octave choir melody chord".split()}
GLUE = ["The {} is checked before the {} is written.", "Users asked to see the {} next to the {}.", "If the {} and the {} disagree, the older one is kept.", "Rounding of the {} follows the {}, not the screen."]
FILLER = ["Nothing else changed here.", "A shorter text is planned for later.", "Open questions are listed at the end.", "Names in the examples are invented."]


def corpus(n=240):
    rng = random.Random(8)
    docs, truth = [], {}
    for i in range(n):
        about = rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 1, 2]))
        lines = [rng.choice(FILLER) for _ in range(4)]
        for s in about:
            lines += [rng.choice(GLUE).format(*rng.sample(TERMS[s], 2)) for _ in range(6)]
        if about and rng.random() < 0.2:
            other = rng.choice(sorted(set(TERMS) - set(about)))
            lines.append(rng.choice(GLUE).format(*rng.sample(TERMS[other], 2)))  # a passing mention
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
        truth[i] = set(about)
    return docs, truth


def found(spark, docs, labels, names=TERMS):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    about = spark.createDataFrame([(s, None) for s in names], "subject string, description string")
    got = {}
    for r in subjects.subjects_of_documents(df, about, spark.createDataFrame(labels, "doc_id bigint, subject string")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    return got


def test_held_out_documents(spark):
    docs, truth = corpus()
    labels = [(i, s.upper() + " ") for i in range(60) for s in truth[i]] + [(1, "nonsense"), (None, "law")]
    got = found(spark, [*docs, (900, None), (901, ""), (902, "  \n"), (903, "\x00…"), (904, "word " * 50_000)], labels)
    right = sum(got.get(i, set()) == truth[i] for i in range(60, len(docs)))
    assert right >= 0.95 * (len(docs) - 60) and not {900, 901, 902, 903} & set(got)


def test_rows_come_from_the_topics(spark, monkeypatch):
    docs, truth = corpus(80)
    labels = [(i, s) for i in range(60) for s in truth[i]]
    assert found(spark, docs, labels)
    fit = subjects.fit_topics

    def zeroed(encoded, names):
        model = fit(encoded, names)
        return subjects.Model(model.weights * 0 + 1, model.totals * 0 + 1, names)

    monkeypatch.setattr(subjects, "fit_topics", zeroed)
    assert not found(spark, docs, labels)


def test_terms_of_the_topics(spark):
    docs, truth = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, s) for i in range(60) for s in truth[i]], "doc_id bigint, subject string")
    rows = subjects.topic_terms(df, spark.createDataFrame([(s,) for s in TERMS], "subject string"), labels, 6).collect()
    for s, terms in TERMS.items():
        assert {r.term for r in rows if r.subject == s} >= set(terms)
    assert any(r.subject is None for r in rows)


def test_a_subject_without_labels_goes_to_no_other(spark):
    docs, truth = corpus()
    got = found(spark, docs, [(i, s) for i in range(60) for s in truth[i] if s != "music"])
    only = [i for i in truth if truth[i] == {"music"}]
    assert not any("music" in x for x in got.values()) and sum(i in got for i in only) <= 0.1 * len(only)


def test_nothing_to_go_by(spark):
    docs, names, labels = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([("law", "")], "subject string, description string"), spark.createDataFrame([], "doc_id bigint, subject string")
    assert subjects.subjects_of_documents(docs, names, labels).count() == 0
    assert subjects.subjects_of_documents(docs, names, spark.createDataFrame([(1, "law")], "doc_id bigint, subject string")).count() == 0
    assert subjects.topic_terms(docs, names, labels).count() == 0


def test_languages_and_sentences():
    assert [subjects.sentences_of(t)[0] for t in ("Das ist nicht der Weg", "No cambie el primer párrafo de la nota", "the end of it", "缺少原告时不计算证人。", "")] == ["de", "es", "en", "zh", "en"]
    assert subjects.sentences_of("Users `x_1` saw the ＢＩＧ dog​ 12. So did 3.4 we\n我们走") == ("en", [["users", "saw", "the", "big", "dog"], ["did"], ["我们", "们走"]])
