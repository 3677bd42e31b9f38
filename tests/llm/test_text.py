import math
import random
from collections import Counter, defaultdict

import pytest

from scoria.llm import bpe, mixture, spam, terms

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS = ["", None, " ", "Hello  world\n\n\tx", "<|endoftext|>it's we'LL they're", "naïve 日本語の文章 ½²Ⅷ ١٢٣", "a" * 3000, "aB" * 800, "= " * 500, "\x1c\x85\u3000 x\u200b\ufeff", "\r\n \r\n", "x" + " " * 999 + "y", "0123456789" * 60]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_the_public_tokenizer(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[3], "repeat"), (None, "no key", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode_texts(df, "doc_id", "text").collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(((i, reference(t)) for i, t, _ in rows), key=key)
    counts = Counter({r.doc_id: r.n_tokens for r in bpe.encode_texts(df.where("doc_id > 0"), "doc_id", "text", counts_only=True).collect()})
    assert counts == Counter({i: len(reference(t)) for i, t in enumerate(TEXTS) if i})
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_random_texts_and_round_trip(spark, reference):
    rnd = random.Random(7)
    alphabet = "abcdefghij ABC.,'!?\n\t0123éßдж字の🚀\u00a0_-=" + " " * 8
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 200))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = bpe.encode_texts(df, "doc_id", "text")
    assert {r.doc_id: list(r.ids) for r in ids.collect()} == {i: reference(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in bpe.decode_ids(ids, "doc_id", "ids").collect()} == dict(enumerate(texts))
    assert [r.text for r in bpe.decode_ids(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), "doc_id", "ids").orderBy("doc_id").collect()] == [None, ""]


def brute_terms(docs):
    import re

    bags = {}
    for k, q, c, n in docs:
        if k is not None:
            text = " ".join(x or "" for x in (q, c, n))
            bags[k] = max(bags.get(k, ("", Counter())), (text, Counter(w.lower() for w in re.findall(terms.WORD, text) if len(w) >= 3)), key=lambda x: x[0])
    bags = {k: v[1] for k, v in bags.items()}
    total, df, col = sum(sum(b.values()) for b in bags.values()), Counter(t for b in bags.values() for t in b), Counter()
    for b in bags.values():
        col.update(b)
    out = {}
    for k, b in bags.items():
        row = sum(b.values())
        for t, o in b.items():
            e = row * col[t] / total
            v = e * (1 - row / total) * (1 - col[t] / total)
            out[k, t] = (o, df[t], (o - e) / math.sqrt(v) if v > 0 else 0.0)
    return out


def test_term_scores_against_brute_force(spark):
    docs = [("d1", "HTTPServer_id2", "budget budget Budget", None), ("d1", "HTTPServer_id2", "budget budget Budget", None), ("d2", None, "budgetLine BUDGETLine budget", "the scanner"), ("d3", "", "", "ab x9y the the the"), ("d4", None, None, None), (None, "budget", "budget", "budget"), ("d5", "a", "x" * 20000, "naïve")]
    df = spark.createDataFrame([(*d, "c", "t") for d in docs], "document_id string, qualified_name string, code string, natural_text string, term string, df string")
    want = brute_terms(docs)
    got = {(r.document_id, r.term): (r.tf, r.df, r.score) for r in terms.term_scores(df).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(got[k][2] == pytest.approx(want[k][2], abs=1e-9) for k in want)
    assert {(r.document_id, r.term) for r in terms.distinctive_terms(df).collect()} == {k for k, v in want.items() if v[0] >= 3 and 2 <= v[1] <= 12}
    assert {t for k, t in got if k == "d1"} == {"http", "server", "budget"}
    assert terms.term_scores(df.limit(0)).count() == 0


def test_mixture_meets_shares_and_caps(spark):
    rnd = random.Random(5)
    rows = [(i, ["big", "small", "none", None][min(3, int(rnd.random() ** 2 * 4))], rnd.choice([0, 5, 50, 500])) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2), (None, 0.2, 1), ("zero", 0.0, 3)], "source string, target_share double, max_repeats int")
    used, plan = mixture.mix_sources(sizes, targets, exact=True)
    have, tokens, by_id = used.collect(), defaultdict(int), {r[0]: r for r in rows}
    for r in have:
        assert r.n_tokens == by_id[r.doc_id][2] > 0 and r.copies <= {"big": 1, "small": 4}[r.source]
        tokens[r.source] += r.n_tokens * r.copies
    assert len({r.doc_id for r in have}) == len(have)
    total = sum(tokens.values())
    assert tokens["big"] / total == pytest.approx(2 / 3, abs=0.01) and tokens["small"] / total == pytest.approx(1 / 3, abs=0.01)
    report = {r.source: r for r in mixture.mixture_report(used, plan).collect()}
    assert set(report) == {"big", "small", "absent", "zero"} and report["absent"].mixed == 0 and report["big"].actual_share == pytest.approx(tokens["big"] / total)
    # By default the mix is planned for what the usable sources hold; a source at its cap falls short and shows it.
    default = {r.source: r for r in mixture.mixture_report(*mixture.mix_sources(sizes, targets)).collect()}
    held = default["big"].available + default["small"].available
    assert default["big"].target_tokens == pytest.approx(held * 2 / 3) and default["big"].short == 0
    assert default["small"].mixed <= 4 * default["small"].available and default["small"].gap == pytest.approx(0.3 - default["small"].actual_share)
    short = {r.source: r.short for r in mixture.mixture_report(*mixture.mix_sources(sizes, targets, total_tokens=10 * held)).collect()}
    assert short["small"] == pytest.approx(10 * held / 3 - 4 * default["small"].available) and short["absent"] == short["zero"] == 0
    full, _ = mixture.mix_sources(sizes, targets, total_tokens=10**9)
    assert all(r.copies == {"big": 1, "small": 4}[r.source] for r in full.collect())
    assert mixture.mix_sources(sizes.limit(0), targets)[0].count() == 0 and mixture.mix_sources(sizes, targets.limit(0))[0].count() == 0


PROSE = "Keep in mind that a narrow meter may outlive the shard that made it. The reason is simple: a policy that can't store its rotas is worth less than none. "
SPAM = {
    "words": "buy pump cheap pump best pump online pump free pump download pump top pump " * 8,
    "links": "\n".join(f"- [cheap tool](https://a{i}.example/x/{i})" for i in range(20)),
    "bare": "\n".join(f"https://a{i}.test/x" for i in range(20)),
    "tags": " ".join(f"#buyTool{i} #free" for i in range(25)),
    "stuffed": "Looking for pump version? Our plugin pump is the best pump for pump buyers. " * 12,
    "upper": "LEASE TOOL, " * 30,
    "wrapped": PROSE[:70] + "\n\n" + "gratis Pumpe kaufen » Pumpe billig » " * 30,
}
HONEST = {
    "prose": PROSE * 3,
    "log": PROSE + "\n" + "\n".join(f"2025-01-0{i} 10:00 INFO Lease: load pump={i}" for i in range(1, 9)) + "\n" + PROSE,
    "contents": "# Pumps\n\n" + "\n".join(f"- [pump{i}](#pump{i})" for i in range(20)) + "\n\n" + PROSE * 2,
    "table": "| option | meaning |\n|-|-|\n" + "\n".join(f"| pump{i} | {PROSE[:68]} |" for i in range(8)),
    "see": PROSE + "\n\nTags: pump, lease, tool\n\nSee also: https://a.test/x https://b.test/y/z",
    "german": "Danach läuft alles wie gewohnt, nur deutlich schneller. Niemand weiß genau, weshalb der Vergleich bei großen Projekten so lange dauert. " * 3,
    "japanese": "古い記録は次の実行まで残ります。このページでは索引の作り方を説明します。" * 5,
    "empty": "", "blank": " \r\n", "null": None, "short": "buy tool",
    "long": PROSE * 2000,
}


#: The same honest paragraph in many languages, and keyword pages in some.
LANGUAGES = {
    "ru": "Этот проект разбирает исходный код и строит по нему граф зависимостей. Чтобы начать работу, установите пакет и запустите команду в корне вашего репозитория. После этого вы сможете искать функции, которые давно никто не вызывает.",
    "it": "Questo strumento legge il codice sorgente e costruisce un grafo delle dipendenze. Per iniziare, installa il pacchetto ed esegui il comando nella cartella principale del progetto. I risultati vengono salvati in un file che puoi aprire con qualsiasi editor.",
    "ko": "이 도구는 소스 코드를 읽고 의존성 그래프를 만듭니다. 시작하려면 패키지를 설치하고 프로젝트 폴더에서 명령을 실행하세요. 결과는 편집기에서 열 수 있는 파일로 저장됩니다. 자세한 내용은 아래 문서를 읽어 보시기 바랍니다.",
    "pl": "To narzędzie czyta kod źródłowy i buduje graf zależności. Aby zacząć, zainstaluj pakiet i uruchom polecenie w głównym katalogu projektu. Wyniki są zapisywane w pliku, który można otworzyć w dowolnym edytorze.",
    "pt": "Esta ferramenta lê o código fonte e constrói um grafo de dependências. Para começar, instale o pacote e execute o comando na pasta principal do projeto. Os resultados são guardados num ficheiro que pode ser aberto em qualquer editor.",
    "nl": "Dit hulpmiddel leest de broncode en bouwt een graaf van afhankelijkheden. Installeer eerst het pakket en voer daarna de opdracht uit in de hoofdmap van het project. De resultaten worden bewaard in een bestand dat je met elke editor kunt openen.",
    "tr": "Bu araç kaynak kodu okur ve bir bağımlılık çizgesi oluşturur. Başlamak için paketi kurun ve komutu projenin ana klasöründe çalıştırın. Sonuçlar herhangi bir düzenleyiciyle açabileceğiniz bir dosyaya kaydedilir.",
    "zh": "这个工具会读取源代码并构建依赖关系图。要开始使用，请安装软件包并在项目的根目录中运行命令。结果会保存到一个可以用任何编辑器打开的文件里。如果遇到问题，请先查看下面的常见问题说明。",
    "ja": "このツールはソースコードを読み取り、依存関係のグラフを作成します。使い始めるには、パッケージをインストールしてプロジェクトの最上位でコマンドを実行してください。結果は任意のエディタで開けるファイルに保存されます。",
    "ar": "تقرأ هذه الأداة الشيفرة المصدرية وتبني مخططا للاعتماديات بين أجزائها. للبدء ثبت الحزمة ثم نفذ الأمر في المجلد الرئيسي للمشروع. تحفظ النتائج في ملف يمكنك فتحه بأي محرر نصوص.",
    "hi": "यह उपकरण स्रोत कोड पढ़ता है और निर्भरताओं का एक ग्राफ बनाता है। शुरू करने के लिए पैकेज स्थापित करें और परियोजना के मुख्य फ़ोल्डर में आदेश चलाएँ। परिणाम एक फ़ाइल में सहेजे जाते हैं जिसे किसी भी संपादक में खोला जा सकता है।",
    "sv": "Det här verktyget läser källkoden och bygger en graf över beroenden. Börja med att installera paketet och kör sedan kommandot i projektets rotmapp. Resultaten sparas i en fil som du kan öppna i valfri redigerare.",
    "cs": "Tento nástroj čte zdrojový kód a sestavuje graf závislostí. Nejprve nainstalujte balíček a potom spusťte příkaz v kořenové složce projektu. Výsledky se ukládají do souboru, který můžete otevřít v libovolném editoru.",
    "el": "Αυτό το εργαλείο διαβάζει τον πηγαίο κώδικα και χτίζει ένα γράφημα εξαρτήσεων. Για να ξεκινήσετε, εγκαταστήστε το πακέτο και εκτελέστε την εντολή στον κύριο φάκελο του έργου. Τα αποτελέσματα αποθηκεύονται σε αρχείο.",
    "th": "เครื่องมือนี้อ่านซอร์สโค้ดและสร้างกราฟของการพึ่งพา ในการเริ่มต้นให้ติดตั้งแพ็กเกจแล้วรันคำสั่งในโฟลเดอร์หลักของโครงการ ผลลัพธ์จะถูกบันทึกลงในไฟล์ที่เปิดได้ด้วยโปรแกรมแก้ไขข้อความใดก็ได้",
    "en": "This tool reads the source code and builds a graph of dependencies. To get started, install the package and run the command in the root folder of your project. The results are saved in a file that you can open with any editor.",
}
KEYWORDS = {
    "ja": "ポンプ 購入 格安 ポンプ 無料 ポンプ 最安値 ポンプ 通販 人気 ポンプ 激安 ポンプ おすすめ ポンプ 比較 ポンプ ランキング " * 3,
    "ja tags": "格安ポンプ、激安ポンプ、人気ポンプ、通販ポンプ、送料無料、最安値、中古、レンタル、修理、部品、価格比較、口コミ、評判、ランキング、" * 2,
    "ru": "купить насос дешево насос цена насос скачать насос бесплатно насос онлайн насос лучший насос " * 4,
    "ko": "펌프 구매 최저가 펌프 무료 펌프 추천 펌프 할인 펌프 순위 펌프 비교 펌프 " * 4,
    "zh": "水泵 价格, 水泵 批发, 水泵 厂家, 便宜 水泵, 水泵 下载, 免费 水泵, 最好 水泵, 水泵 促销, " * 4,
    "pl": "pompa tanio, pompa sklep, pompa cena, pompa online, najlepsza pompa, pompa za darmo, pompa opinie, " * 4,
    "one sentence": "You can buy the best code analysis tool for your team in Berlin today\n" * 50,
    "headings": "# cheap pump buy\n# best pump free\n# pump download top\n# pump online sale\n" * 8,
    "open fence": "```\n" + "buy pump cheap pump best pump online pump free pump download pump top pump " * 8,
    "label": "Keywords: " + "buy pump | cheap pump | best pump | online pump | " * 20,
}


def test_spam_pages(spark):
    rows = [(k, t, "x", 1) for k, t in {**SPAM, **HONEST}.items()] + [("words", SPAM["words"], "again", 2)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, prose int")
    got = [r.doc_id for r in spam.spam_pages(df).select("doc_id").collect()]
    assert set(got) == set(SPAM) and got.count("words") == 2
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_spam_in_many_languages(spark):
    rows = [("honest " + k, v, k) for k, v in LANGUAGES.items()] + [("spam " + k, v, k) for k, v in KEYWORDS.items()]
    alone = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    want = {k for k, _, _ in rows if k.startswith("spam")}
    assert {r.doc_id for r in spam.spam_pages(alone).collect()} == want
    # Beside a corpus from which English is learned, the same pages are judged alike.
    rnd = random.Random(4)
    nouns = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    corpus = [(f"en{i}", " ".join(f"The {rnd.choice(nouns)} of a {rnd.choice(nouns)} is in the {rnd.choice(nouns)} and it was not for the {rnd.choice(nouns)}." for _ in range(6)), "en-XX") for i in range(150)]
    both = spark.createDataFrame(rows + corpus, "doc_id string, text string, lang string")
    learned = spam.learn_languages(both)
    assert set(learned) == {"en"} and {"the", "of", "is"} <= set(learned["en"].function) and "bal" not in learned["en"].function
    keywords = " ".join(rnd.choice(nouns) for _ in range(80))
    more = both.unionByName(spark.createDataFrame([("spam no function words", keywords, None)], both.schema))
    found = {r.doc_id: r.reason for r in spam.spam_pages(more).collect()}
    assert set(found) == want | {"spam no function words"}, found
