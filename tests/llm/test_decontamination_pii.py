import random
import re

from ledgerloom.llm.decontamination import contaminated, decontaminated
from ledgerloom.llm.pii import entities, pii_surrogates


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


QUESTION = "If Anna has 12 apples and gives 5 kg to Bob, how many apples does Anna keep after 3 days of waiting?"


def test_reparameterised_questions(spark, docs_of):
    docs = docs_of([
        "So: If Zoe has 90 apples and gives 7 kg to Max, how many apples does Zoe keep after 2 days of waiting? Right.",
        "If Zoe has 90 apples and gives 7 kg to Max, how many apples does Max keep after 2 days of waiting?",  # inconsistent
        QUESTION.upper().lower(),
        "If Anna has 12 apples and gives 5 kg to charity then all is well.",
        None,
        "",
    ])
    got = {r.doc_id for r in contaminated(docs, items(spark, [QUESTION, None, "", "too short"])).collect()}
    assert got == {0}
    assert {r.doc_id for r in decontaminated(docs, items(spark, [QUESTION])).collect()} == {1, 2, 3, 4, 5}


def test_slots_that_become_equal_and_windows_that_count_alone(spark, docs_of):
    walk = "If Anna walks for 3 hours in the hills and then rests for 1 hour, how far does she get before the evening comes?"
    plain = "The old miller and his two sons carried all the grain over the narrow bridge before 12 men and 15 women came to buy 12 sacks"
    docs = docs_of([
        walk.replace("3 hours", "4 hours").replace("1 hour", "2 hours"),  # hours and hour both meet hours
        walk.replace("3 hours", "2 hours").replace("1 hour", "2 hours"),  # two numbers become the same
        plain.replace("before 12", "before 30").replace("buy 12", "buy 40"),  # 12 meets two numbers; the start has no slots
        plain.replace("before 12", "before 30").replace("The old miller and", "Some"),  # nothing long enough is left
    ])
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items(spark, [walk, plain])).collect()}
    assert {(0, 0), (1, 0), (2, 1)} <= got and not got & {(0, 1), (1, 1), (2, 0), (3, 0)}


def test_short_items_and_items_without_telling_windows(spark, docs_of):
    bench = ["What is the capital of France?", "12 + 7 - 3 * 4 / 2 + 9 = what?", "What is the tallest of all mountains in Asia?", "too short"]
    docs = docs_of([
        "So he asked: what is the capital of France? Nobody knew.",
        "The capital of France is what it is.",
        "Add up 12 + 7 - 3 * 4 / 2 + 9 = what? Then rest.",
        "Add up 12 + 7 - 3 * 4 / 2 + 8 = what? Then rest.",
        "so they asked him What is the tallest of all mountains in Asia? and left",
        "so they asked him Where is the tallest of all mountains in Asia? and left",
        "What is the capital of",
    ])
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items(spark, bench)).collect()}
    assert got == {(0, 0), (2, 1), (4, 2)}


def test_coverage_is_counted_along_one_alignment(spark, docs_of):
    bench = ["one small step for a man and then one giant leap for all the others who came"]
    first, second = " ".join(bench[0].split()[:8]), " ".join(bench[0].split()[8:16])
    docs = docs_of([f"{first} red green blue {second}", f"{first} {second}", f"{second} {first}"])
    assert {r.doc_id for r in contaminated(docs, items(spark, bench)).collect()} == {1}


def test_items_that_share_an_id_or_have_none(spark, docs_of):
    a, b = "the quick brown fox jumps over a lazy dog near our old river bank", "every good boy deserves some fruit before the long school day has ended"
    bench = spark.createDataFrame([(1, a), (1, b), (None, a), (1, a), (2, None)], "item_id long, text string")
    docs = docs_of([a, b, "neither of them", a + " and " + b])
    got = sorted(((r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(0, 1), (0, None), (1, 1), (3, 1), (3, None)], key=str)


def by_hand(docs, bench, least=12, window=8, literals=5):
    """Pairs of documents and items without names and units: template windows, slots a function along an alignment, coverage."""
    cut = lambda t: re.findall(r"[a-z0-9]+", t)
    kind = lambda w: "#" if w[0].isdigit() else w
    out = set()
    for i, d in enumerate(docs):
        for j, q in enumerate(bench):
            x, y = cut(d), cut(q)
            for shift in range(-len(y), len(x)):
                met = []
                for k in range(len(y) - window + 1):
                    own, item = x[k + shift : k + shift + window] if k + shift >= 0 else [], y[k : k + window]
                    if len({w for w in map(kind, item) if w != "#"}) >= literals and list(map(kind, own)) == list(map(kind, item)):
                        met.append((k, own, item))
                pairs = {(b, a) for _, own, item in met for a, b in zip(own, item) if b[0].isdigit()}
                fits = len({b for b, _ in pairs}) == len(pairs)
                covered = {p for k, own, item in met if fits or own == item or not any(w[0].isdigit() for w in item) for p in range(k, k + window)}
                if covered and len(covered) >= min(least, len(y)):
                    out.add((i, j))
    return out


def test_equals_brute_force_on_numbered_texts(spark, docs_of):
    rng = random.Random(21)
    vocabulary = "al be ce do em fu gi ho iv ju ka lo mi no op qu".split()
    make = lambda n: [rng.choice(vocabulary) if rng.random() < 0.85 else str(rng.randint(1, 4)) for _ in range(n)]
    bench = [make(rng.randint(15, 24)) for _ in range(12)]
    docs = []
    for _ in range(120):
        words = make(rng.randint(0, 12))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(bench)
            a = rng.randint(0, len(item) - 9)
            part = item[a : a + rng.randint(9, 24)]
            swap = {str(k): str(rng.randint(1, 9)) for k in range(1, 5)} if rng.random() < 0.6 else {}
            part = [swap.get(w, w) if rng.random() < 0.97 else str(rng.randint(1, 9)) for w in part]
            if rng.random() < 0.3:
                part.insert(rng.randint(1, len(part)), rng.choice(vocabulary))
            words += part + make(rng.randint(0, 6))
        docs.append(" ".join(words))
    bench = [" ".join(b) for b in bench]
    want = by_hand(docs, bench)
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_of(docs), items(spark, bench)).collect()}
    assert len(want) > 20 and got == want


def test_planted_passages_and_clean_texts(spark, docs_of):
    rng = random.Random(7)
    words = ["".join(rng.choices(["an", "re", "th", "el", "ou", "st"], k=rng.randint(1, 4))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    bench = [prose(rng.randint(16, 59)).capitalize() + "." for _ in range(30)]
    docs, want = [], set()
    for i in range(200):
        text = prose(rng.randint(0, 300))
        if i % 7 == 0:
            k = rng.randrange(30)
            text += "\n" + bench[k] + " " + prose(20)
            want.add((i, k))
        docs.append(text)
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_of(docs), items(spark, bench)).collect()}
    assert got == want


def test_decontamination_of_odd_rows(spark, odd_docs):
    bench = items(spark, [QUESTION])
    assert contaminated(odd_docs, bench).count() == 0
    assert decontaminated(odd_docs, bench).columns == odd_docs.columns
    assert decontaminated(odd_docs, bench).count() == odd_docs.count()
    assert contaminated(odd_docs, bench.limit(0)).count() == 0 and contaminated(odd_docs.limit(0), bench).count() == 0


PII = [
    "Dear Mr. John Smith and Mrs Mary Jones, call +49 (30) 1234-5678 or 4111 1111 1111 1111.",
    "Mr Smith: HI@X.ORG, hi@x.org, 10.20.30.40 and DE89370400440532013000, 123-45-6789",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" +49 30 1234 5678',
    "Dr. Иванов и Herr Müller",
    None,
    "nothing in 2024 at 10:30, version 1.2, 12 items",
]


def luhn(digits):
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_surrogates_keep_type_format_and_coreference(docs_of):
    docs = docs_of(PII)
    got = {r.doc_id: r for r in pii_surrogates(docs).collect()}
    text = {i: r.text for i, r in got.items()}
    for secret in ("John", "Mary", "Smith", "Jones", "1234-5678", "4111 1111", "X.ORG", "10.20.30.40", "DE8937", "123-45-6789", "24be6443", "Иванов", "Müller"):
        assert not any(secret in (t or "") for t in text.values()), secret
    assert text[4] is None and text[5] == PII[5] and got[5].n_entities == 0
    male, female = re.match(r"Dear Mr\. (\w+) (\w+) and Mrs (\w+) (\w+),", text[0]).groups()[::2]
    from ledgerloom.llm.pii import GIVEN

    assert male in GIVEN["m"] and female in GIVEN["f"]
    family = re.match(r"Dear Mr\. \w+ (\w+)", text[0])[1]
    assert text[1].startswith(f"Mr {family}:")
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", text[0])[0]
    assert luhn(card.replace(" ", ""))
    upper, lower = re.search(r"(\S+@\S+), (\S+@\S+),", text[1]).groups()
    assert upper.isupper() and upper.lower() == lower
    phone = re.search(r"\+(\d\d) \((\d\d)\) (\d{4})-(\d{4})", text[0]).groups()
    assert text[2].endswith("+{} {} {} {}".format(*phone))
    assert re.search("[а-я]", text[3].split()[1])
    again = {r.doc_id: r.text for r in pii_surrogates(docs).collect()}
    other = {r.doc_id: r.text for r in pii_surrogates(docs, "another key").collect()}
    assert again == text and other[0] != text[0]


def test_distinct_entities_stay_distinct(docs_of):
    docs = docs_of([f"card 4{k:015d} ip 10.0.{k // 250}.{k % 250 + 1} Mr Sm{'abcdefghij'[k % 10]}th{'klmnopqrst'[k // 10 % 10]}" for k in range(600)])
    before = {(r.kind, r.value) for r in entities(docs).collect()}
    after = {(r.kind, r.value) for r in entities(pii_surrogates(docs)).collect()}
    assert {k: sum(x == k for x, _ in before) for k in ("card", "ip", "name")} == {k: sum(x == k for x, _ in after) for k in ("card", "ip", "name")}
    assert not before & after


def test_more_entities_than_the_shortest_surrogates(spark, monkeypatch):
    from ledgerloom.llm import pii

    monkeypatch.setattr(pii, "SYLLABLES", {k: v[:2] for k, v in pii.SYLLABLES.items()})  # 16 names of four syllables
    things = [("name", f"person{k}") for k in range(40)] + [("email", f"{c}@x.org") for c in "abcdefghijklmnopqrst"]
    got = pii.surrogates(spark.createDataFrame(things, "kind string, value string"), "key").collect()
    assert len(got) == 60 and len({(r.kind, r.new) for r in got} - set(things)) == 60


def test_names_without_titles_given_names_and_labelled_secrets(docs_of):
    docs = docs_of([
        "Mr. John Smith came. Smith said that John's bag is SMITH's.",
        "Dr. John Smith and Mr. Tom Smith and Mr. Tim Smith",
        "My name is Zed Quill. Name: Una Vex. Then Robert Harlow left. Quill stayed",
        'password: hunter2!x and api_key = "Zx9_qqLmno" and ghp_abcdefghijklmnopqrst12',
        "Smith is a trade, and token is a word: nothing else.",
    ])
    text = {r.doc_id: r.text for r in pii_surrogates(docs).collect()}
    for i, words in enumerate(("John Smith SMITH", "John Tom Tim Smith", "Zed Quill Una Vex Robert Harlow", "hunter2 Zx9_qq abcdefghij")):
        assert not [w for w in words.split() if w in text[i]], text[i]
    given, family, again, first, upper = re.match(r"Mr\. (\w+) (\w+) came\. (\w+) said that (\w+)'s bag is (\w+)'s\.$", text[0]).groups()
    assert (again, first, upper) == (family, given, family.upper())
    people = re.match(rf"Dr\. (\w+) {family} and Mr\. (\w+) {family} and Mr\. (\w+) {family}$", text[1]).groups()
    assert people[0] == given and len(set(people)) == 3
    quill = re.match(r"My name is \w+ (\w+)\. Name: \w+ \w+\. Then \w+ \w+ left\. (\w+) stayed$", text[2]).groups()
    assert quill[0] == quill[1]
    assert re.match(r'password: \S+ and api_key = "\w+" and \w+$', text[3]) and text[4] == "Smith is a trade, and token is a word: nothing else."


def test_stacked_titles_and_plain_phone_numbers(docs_of):
    docs = docs_of([
        "Herr Dr. Müller and Mr Dr Smith met Mrs Jane Roe and Mr Bob Poe",
        "Dr. Jane Roe and Dr Mrs Jane Roe and Mr Bob Poe",
        "call 5551234567 or +4915112345678, not 1712345678 or 12345678901234567890123 or v5551234567",
        "Dr John Smith; Mr John Smith",
    ])
    text = {r.doc_id: r.text for r in pii_surrogates(docs).collect()}
    from ledgerloom.llm.pii import GIVEN

    jane, roe, bob, poe = re.match(r"Herr Dr\. \w+ and Mr Dr \w+ met Mrs (\w+) (\w+) and Mr (\w+) (\w+)$", text[0]).groups()
    assert jane in GIVEN["f"] and bob in GIVEN["m"]
    assert text[1] == f"Dr. {jane} {roe} and Dr Mrs {jane} {roe} and Mr {bob} {poe}"
    assert re.match(r"call \d{10} or \+\d{13}, not 1712345678 or 12345678901234567890123 or v5551234567$", text[2])
    assert "5551234567 or" not in text[2] and "4915112345678" not in text[2]
    one, other = re.match(r"Dr (\w+ \w+); Mr (\w+ \w+)$", text[3]).groups()
    assert one == other


def test_as_many_people_as_a_small_town(spark):
    from ledgerloom.llm.pii import surrogates

    people = spark.range(100_000).selectExpr("if(id % 2 = 0, 'name', 'given') AS kind", "concat('person', id) AS value", "if(id % 3 = 0, 'm', 'f') AS gender")
    got = surrogates(people, "key").selectExpr("count(*)", "count(DISTINCT kind, value)", "count(DISTINCT kind, new)", "count_if(new LIKE 'person%')").first()
    assert tuple(got) == (100_000, 100_000, 100_000, 0)


def test_a_text_of_many_mentions_and_a_null_id(docs_of):
    long = " ".join(f"Mr Adam Quill{'abcdefghij'[k % 10]}x wrote to a{k % 50}@x.org;" for k in range(3000))
    got = {r.doc_id: r for r in pii_surrogates(docs_of([(1, long), (None, "Mr Adam Quillax"), (None, "a7@x.org")])).collect()}
    assert got[1].n_entities == 6000 and "Quill" not in got[1].text and "@x.org" in got[1].text


def test_surrogates_of_odd_rows(odd_docs):
    got = pii_surrogates(odd_docs)
    assert got.count() == odd_docs.count()
    assert {r.doc_id: r.text for r in got.collect()} == {r.doc_id: r.text for r in odd_docs.collect()}
    assert pii_surrogates(odd_docs.limit(0)).count() == 0
