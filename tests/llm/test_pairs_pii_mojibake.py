import pytest
from pyspark.sql import functions as F

from tidewright.llm import mojibake, pairs, pii

GOOD = "The router keeps a queue for each tenant and drains it in order."


@pytest.mark.parametrize(
    "prompt, answer, want",
    [
        ("Why is it slow?", None, ["empty"]),
        ("Why is it slow?", " \ufeff—\n", ["empty"]),
        ("Why is it slow?", "**why is it slow**", ["copy"]),
        ("Why is it slow?", "Q: Why is it slow?\nWhy is it slow?", ["copy"]),
        ("Why is it slow?", "Why is it slow? " + GOOD, []),
        ("Why is it slow?", "I'm sorry, but I can't help with that. Is there anything else you would like to know?", ["refusal"]),
        ("Why is it slow?", "I'm sorry to hear that. Restart the router first.", []),
        ("Why is it slow?", "A reply such as “I can't help with that” makes the router fall back. " + GOOD, []),
        ("Warum ist der Router langsam und die Antwort leer?", "Leider kann ich dabei nicht helfen.", ["refusal"]),
        ("Why is it slow?", GOOD[:-10], ["truncated"]),
        ("Why is it slow?", "```python\nfor x in y:\n    print(x", ["truncated"]),
        ("Why is it slow?", GOOD + "\n\n```python\nprint(1)\n```", []),
        ("How many?", "42", []),
        ("Is it?", "Yes", []),
        ("List three.", "- a first one\n- a second one\n- a third one", []),
        ("Why is the router so slow in the morning?", "Der Router ist am Morgen langsam, weil die Warteschlange voll ist.", ["other_language"]),
        ("Why is the router slow? Please reply in German.", "Der Router ist am Morgen langsam, weil die Warteschlange voll ist.", []),
        (None, GOOD, []),
        ("Why is the router so slow in the early morning?", "Why is the router so slow in the ear", ["truncated", "copy"]),
        ("Why is the router so slow in the early morning?", "Why is the router so slow in the early morning? Well, the", ["truncated", "copy"]),
        ("Why is the router so slow in the early morning?", "Why is the router so slow in the early morning? " + GOOD, []),
        ("Slow router?", "Роутер ждёт блокировки и поэтому медленный.", ["other_language"]),
        ("Медленный роутер?", "Роутер ждёт блокировки и поэтому медленный.", []),
        ("", "Роутер ждёт блокировки и поэтому медленный.", []),
        ("Why is it slow?", "I cannot help with that because the", ["refusal", "truncated"]),
        ("Why is it slow?", "The setting (see the docs is on.", ["truncated"]),
    ],
)
def test_defects(prompt, answer, want):
    assert pairs.defects(prompt, answer) == want


@pytest.mark.parametrize(
    "prompt, answer, want",
    [
        ("Why is it slow?", "I'm sorry, but I can't help with th", ["refusal", "truncated"]),
        ("Why is it slow?", "```\nWhy is it slow?", ["copy", "truncated"]),
        ("Why is it slow?", "Why is it slow (", ["copy", "truncated"]),
        ("Why is the router so slow in the morning?", "Leider kann ich dir bei der Frage nicht helfen (das ist nicht", ["refusal", "truncated", "other_language"]),
        ("Why is it slow?", "It waits for a lock (see the log of the router.", ["truncated"]),
        ("Why is it slow?", "The log says “lock held by the router. It waits.", ["truncated"]),
        ("Why is it slow?", "Das Log sagt „Sperre“ und «Router», see [0, 1) and \"it waits\" :( on a 5\" disk.", []),
        ("Why is it slow?", "“It waits.\n\n“It waits again.” That is (a) the lock, b) the `(` sign.", []),
        ("Why is it slow?", "```", ["empty", "truncated"]),
    ],
)
def test_every_rule_is_asked_and_open_delimiters_come_before_the_last_mark(prompt, answer, want):
    assert pairs.defects(prompt, answer) == want


def test_judge_counts_copies_once_and_takes_empty_tables(spark):
    rows = [("s", 1, "q", None, "x"), ("s", 1, "q", None, "x"), ("s", 2, "q", GOOD, "x")]
    df = spark.createDataFrame(rows, "source string, pair_id bigint, prompt string, answer string, defect string")
    assert [(r["pair_id"], r["defect"]) for r in pairs.judge(df).collect()] == [(1, "empty")]
    assert pairs.judge(df.where("false")).count() == 0


def test_choices_in_any_order_and_null_lists(spark):
    kind = "completion_id bigint, messages array<struct<role:string,content:string,name:string>>, choices array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>"
    ask = [("user", "first?", None), ("assistant", "x", None), ("user", "last?", None)]
    rows = [(1, ask, [(1, ("assistant", "one"), "stop"), (0, ("assistant", "zero"), "stop")]), (2, None, None), (3, [], []), (4, ask, [(0, None, "stop")])]
    got = {r["pair_id"]: (r["prompt"], r["answer"]) for r in pairs.completions(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("last?", "zero"), 2: (None, None), 3: (None, None), 4: ("last?", None)}


TEXT = (
    "My name is Grace Penhaligan. Write to ines.o-t@post.example or miles (at) nordhaus (dot) test. Call me on (212) 555-0147. "
    "My social security number is 938-05-9689. I live at Flat 3, 126 Tern Gate Road, Port Ellery. Ich wohne hier: Sperberallee 30, 99872 Ostheim. "
    "J’habite 165 bis rue des Tisserands, 99175 Valmorec. Tadeo Penhaligan wrote the first draft."
)
WANT = [
    ("name", "Grace Penhaligan"), ("email", "ines.o-t@post.example"), ("email", "miles (at) nordhaus (dot) test"), ("phone", "(212) 555-0147"), ("id_number", "938-05-9689"),
    ("address", "Flat 3, 126 Tern Gate Road"), ("address", "Sperberallee 30"), ("address", "165 bis rue des Tisserands"), ("name", "Tadeo Penhaligan"),
]
SOUND = "Order 88-05-840 was cached. Build 2.3.20 answers in 522 ms on 10.0.220.7. Will Rose dashboards load? May will be quiet. user: system@ prompt v4. ISBN-like code 000-1-6-0. Latency@p95 rose."


def test_pii_items_by_type_and_nothing_in_look_alikes():
    p = pii.Patterns(frozenset({"grace", "miles", "rose", "will"}))  # "penhaligan" is known, so no cue is needed
    assert [(k, TEXT[a:b]) for a, b, k in pii.find(p, TEXT, frozenset({"penhaligan"}))] == WANT
    assert pii.find(p, SOUND, frozenset({"penhaligan"})) == []


def _known(spark, given=(), family=(), full=()):
    return spark.createDataFrame([(k, w) for k, own in (("given", given), ("family", family), ("full", full)) for w in own], "kind string, word string")


def test_redaction_keeps_coreference_distinctness_and_the_rest(spark):
    rows = [(1, TEXT), (2, "Please ask for Grace Penhaligan. Please ask for PENHALIGAN, GRACE. Please ask for Miles Thornquay. Please ask for Mrs Penhaligan."), (3, None), (4, ""), (5, SOUND), (5, SOUND), (6, "My mobile is 555-0101. " * 2000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "m bigint, body string, id string")
    known = _known(spark, ("grace", "miles"), ("penhaligan", "thornquay"))
    found = pii.detect(df, "m", "body", known)
    out = {r["m"]: r for r in pii.redact(df, "m", "body", found, b"secret").collect()}
    assert out[3]["placeholders"] is None and out[4]["surrogates"] == "" and out[5]["surrogates"] == SOUND
    assert out[1]["placeholders"].startswith("My name is [NAME]. Write to [EMAIL] or [EMAIL]. Call me on [PHONE].")
    assert out[6]["placeholders"].count("[PHONE]") == 2000
    one = out[1]["surrogates"].split("My name is ")[1].split(". Write")[0]
    same, turned, other, alone = (x.split(".")[0] for x in out[2]["surrogates"].split("Please ask for ")[1:])
    first, last = one.split()
    assert same == one and turned == f"{last}, {first}".upper() and other.split()[0] != first and other.split()[1] != last and alone == f"Mrs {last}"
    assert first in pii.GIVEN["latin", "f"] and other.split()[0] in pii.GIVEN["latin", "m"]
    assert pii.detect(df.where("false"), "m", "body", known).count() == 0
    with pytest.raises(ValueError):
        pii.redact(df, "m", "body", found, b"")


def test_names_are_learned_and_joined_alike_whatever_their_number(spark):
    rows = [(i, f"My name is {g} Harroway.") for i, g in enumerate(("Grace", "Tadeo", "Priya"))] + [
        (10, "Sveta Harroway signed. Mira Castelmor did not."), (11, "This is Kofi Ilverne. Later Kofi Ilverne left, and Ilverne said so."), (12, "Grace Quill and Miles Quill came; Anna Quill too."),
        (20, "Call Grace Order it now"), (21, "Call Miles Order it now"), (22, "Call Rose Order it now"), *((30 + i, "An order is an order.") for i in range(8)),
        (13, "Will Sonnet Large load? Will Rose dashboards?"), (14, "Please contact Grace Velmont or contact Support Team."), (15, None), (16, ""),
    ]
    df = spark.createDataFrame(rows, "m bigint, body string")
    names = spark.createDataFrame([("Grace",), ("Miles",), ("Will",), ("Rose",), (" ",), (None,)], "given_name string")
    got = [sorted((r["m"], r["value"]) for r in pii.items(df, "m", "body", names, bound=b).where("pii_type = 'name'").collect()) for b in (300_000, 0)]
    assert got[0] == got[1]
    assert got[0] == [
        (0, "Grace Harroway"), (1, "Tadeo Harroway"), (2, "Priya Harroway"), (10, "Sveta Harroway"), (11, "Kofi Ilverne"), (11, "Kofi Ilverne"), (12, "Anna Quill"), (12, "Grace Quill"), (12, "Miles Quill"), (14, "Grace Velmont"),
    ]


def test_surrogates_keep_type_and_format():
    made = lambda kind, value, title="", key=b"k": pii.rendered(kind, value, [pii.surrogate(k, e, h, key) for k, e, h in pii.parts_of(kind, value, title)])
    assert made("phone", "+49 30 1234567").startswith("+49 ") and made("phone", "0044 (0)20 79460192").startswith("0044 (0)") and made("phone", "020 7946 0192")[0] == "0"
    assert made("phone", "+49 30 1234567") == made("phone", "+49-30-1234567").replace("-", " ") != made("phone", "+49 30 1234567", key=b"other")
    assert pii.regex.fullmatch(r"[A-Z]\d{7}-[A-Z]", made("id_number", "X1234567-L"))
    one, two = made("email", "ann@post.example"), made("email", "bob (at) post (dot) example")
    assert one.split("@")[1] == two.split(" (at) ")[1].replace(" (dot) ", ".")
    f, m, n = made("name", "Carmen Diaz").split()[0], made("name", "Luca Diaz").split()[0], made("name", "Sorrel Diaz").split()[0]
    assert f in pii.GIVEN["latin", "f"] and m in pii.GIVEN["latin", "m"] and n in pii.GIVEN["latin", ""]
    assert made("name", "Luca Diaz", "frau").split()[0] in pii.GIVEN["latin", "f"]
    assert made("name", "Ines van der Luyk").split()[1:3] == ["van", "der"] and made("name", "Иван Ильин").split()[0] in pii.GIVEN["cyrillic", "m"]
    assert made("address", "Flat 3, 126 Tern Gate Road").endswith(" Gate Road") and made("address", "Sperberallee 30").split()[0].endswith("allee")


def test_surrogates_that_collide_move_on(spark, monkeypatch):
    rows = [(i, "name", 0, 9, f"{g} Nadia", "", True) for i, g in enumerate(("Tadeo", "Sorrel", "Kofi", "Ewa", "Dagny", "Yannis", "Robin", "Kim", "Brunhild", "Maida", "Orlo"))]
    rows += [(i, "phone", 0, 8, f"555-01{i:02}", "", True) for i in range(60)]
    found = spark.createDataFrame(rows, pii.FOUND.format(kind="bigint"))
    made = pii.surrogates(found, b"k").collect()
    entities = {(r["kind"], r["entity"]) for r in made}
    assert len({(r["kind"], r["made"].lower()) for r in made}) == len(made) == 11 + 1 + 60
    assert not {(r["kind"], r["made"].lower()) for r in made} & entities


BAD = "La mÃ©trique conserve la mÃ©moire pendant la nuit, cÃ´tÃ© serveur."
FINE = "La métrique conserve la mémoire pendant la nuit, côté serveur."


def _corpus():
    fr = [(i, f"{FINE} Le délai numéro {i} précède l’été, après la mise à jour.", "fr") for i in range(80)]
    ru = [(100 + i, f"Сервер измеряет запрос в рабочей среде, показатель {i}. Словарь заменяет журнал по плану.", "ru") for i in range(80)]
    return fr + ru


def test_restoring_wrong_encodings(spark):
    koi = "Словарь заменяет журнал по плану.".encode("koi8-r").decode("cp1251")
    double = FINE.encode().decode("latin-1").encode().decode("latin-1")
    rows = _corpus() + [(900, BAD, None), (901, koi, "RU"), (902, double, "fr"), (903, "Readers that show `â€”` use the wrong charset.", "en"), (904, None, "fr"), (905, "", None), (906, "lost � sign", "en"), (907, FINE, "fr"), (907, FINE, "fr"), (908, "DECISÃO, Ñandú and Ð.", "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc bigint, body string, l string, text string")
    out = {r["doc"]: (r["restored"], r["damaged"]) for r in mojibake.repair(df, "doc", "body", "l").collect()}
    assert out[900] == (FINE, True) and out[901] == ("Словарь заменяет журнал по плану.", True) and out[902] == (FINE, True)
    assert out[906] == ("lost � sign", True)
    assert not out[903][1] and out[904] == (None, False) and out[905] == ("", False) and out[907] == (FINE, False) and not out[908][1]
    assert not any(out[i][1] for i, _, _ in _corpus())
    assert mojibake.repair(df.where("false"), "doc", "body", "l").count() == 0


def test_restoring_short_stretches_inside_other_text(spark):
    word = "Словарь заменяет журнал"
    parts = {900: ("cp1251", "latin-1"), 901: ("koi8-r", "latin-1"), 902: ("cp866", "cp437")}
    text = lambda w: f'{{"level": "info", "component": "router", "cache": "miss", "retries": 3, "café": true, "title": "{w}"}}'
    say = lambda w: f"The router wrote {w} to the log and went on."
    rows = _corpus() + [(910, say("кэш".encode("koi8-r").decode("cp1251")), None), (911, say("東京の天気".encode("cp932").decode("cp1252")), "en")]
    rows += [(i, text(word.encode(a).decode(b)), None) for i, (a, b) in parts.items()] + [(903, "Журнал".encode("cp1251").decode("latin-1")[:5] + " is full", None), (904, text(word), None)]
    out = {r["doc"]: (r["restored"], r["damaged"]) for r in mojibake.repair(spark.createDataFrame(rows, "doc bigint, body string, l string"), "doc", "body", "l").collect()}
    assert all(out[i] == (text(word), True) for i in parts)
    # this corpus teaches no Japanese, so only the damage is sure; the right reading must be among the candidates
    assert out[910][1] and out[911][1]
    plain = mojibake.Restorer({}, frozenset())
    for right, wrote, read in (("кэш", "koi8-r", "cp1251"), ("日本語", "euc-jp", "latin-1"), ("東京の天気", "cp932", "cp1252")):
        assert say(right) in plain.candidates(say(right.encode(wrote).decode(read)))
    assert out[903] == ("Журна is full", True) and out[904] == (text(word), False)
    assert not any(out[i][1] for i, _, _ in _corpus())


def test_letters_of_a_script_that_the_sample_lacks_are_sound(spark):
    greek = "Ο δρομολογητής περιμένει το κλείδωμα και η ουρά μεγαλώνει."
    rows = _corpus() + [(500 + i, f"{greek} {i}" + " word" * 1000, None) for i in range(5)] + [(600, BAD, None)]  # too long for the sample
    df = spark.createDataFrame(rows, "doc bigint, body string, l string")
    own = mojibake.own_signs(df, "body")
    assert set("δρομλγητή") <= own and not own & set("éÃ©в")
    out = {r["doc"]: r["damaged"] for r in mojibake.repair(df, "doc", "body", "l").collect()}
    assert out[600] and not any(out[500 + i] for i in range(5))


def test_all_sound_texts_teach_whatever_their_number_and_length(spark):
    order = [r[0] for r in spark.range(1200).orderBy(F.xxhash64("id")).collect()]  # the last ones were beyond the sample
    late = "Das Straßenverzeichnis enthält den Schlüssel {}, der Zähler läuft weiter."
    rows = [(i, (late if n >= 800 else "Der Dienst misst die Anfrage {} und schreibt sie in das Protokoll.").format(i), "de") for n, i in enumerate(order)]
    rows += [(2000 + i, f"Το αρχείο {i} είναι μεγάλο. " * 300, "el") for i in range(20)]  # 7,000 characters each
    df = spark.createDataFrame(rows, "doc bigint, body string, l string")
    dictionaries, familiar = mojibake.train(df, "body", "l", "doc")
    assert "Straßenverzeichnis".encode() in dictionaries["de"] and "αρχείο".encode() in dictionaries["el"]
    assert set("ßäüαρχείο") <= familiar
    again, same = mojibake.train(df.repartition(7), "body", "l", "doc")
    assert again == dictionaries and same == familiar


def test_personal_data_in_empty_tables_and_dirt(spark):
    names = spark.createDataFrame([("Grace",)], "given_name string")
    rows = [(1, None), (2, ""), (3, " \n"), (None, "Call me on (212) 555-0147."), (5, "Grace\x00 \ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16", "replace")), (6, "My name is Grace Penhaligan. " * 3000), (6, "My name is Grace Penhaligan. " * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "m bigint, body string, value string")
    for own, given in ((df, names), (df, names.where("false")), (df.where("false"), names)):
        found = pii.items(own, "m", "body", given)
        out = pii.redact(own, "m", "body", found, b"k").collect()
        assert len(out) == own.count()
    found = pii.items(df, "m", "body", names).groupBy("m", "pii_type").count().collect()
    assert {(r["m"], r["pii_type"]): r["count"] for r in found} == {(None, "phone"): 1, (6, "name"): 3000}
