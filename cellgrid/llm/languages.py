"""The language of a text, by a naive Bayes model over hashed character n-grams of its words.

The model starts from a few public sentences per language (the first article of the
Universal Declaration of Human Rights and everyday report prose) and learns from the
labelled texts of a corpus: every text with a known label is counted, over the whole
table, into languages x SLOTS numbers per task, which are added up. An n-gram that a
language has not shown falls back to its share over all languages, so a language that the
corpus holds little of is not shut out by one that it holds much of.

Only words that do not start in upper case count (names, and the nouns of some languages,
tell nothing here), unless the whole text is in capitals. Scripts count as n-grams, too.

Defined results: null, empty and blank texts, numbers and names alone, and texts whose best
language does not lead clearly have the language ''; labels are compared by their part
before the first hyphen or underscore, in lower case; unknown labels are not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import slices

SLOTS = 1 << 17
#: Pseudo-counts of the background in each language, its least share, the share of the samples beside a corpus, the power that corpus counts
#: are damped by, and the lead in log units that settles a language (more for few letters).
WEIGHT, FLOOR, SAMPLED, DAMPED, LEAD, SHORT = 1000.0, 0.15, 0.5, 0.75, 3.0, 40.0
#: Letters of a text that is judged at all, in Latin and in other scripts.
LETTERS, LETTERS_OTHER = 12, 4
_WORDS = re.compile(r"[^\W\d_]+")
_SCRIPTS = ((0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0700, 3), (0x0900, 6), (0x0980, 3), (0x0E00, 7), (0x0E80, 3),
            (0x1E00, 0), (0x1F00, 1), (0x2000, 3), (0x3040, 8), (0x3100, 3), (0x3400, 9), (0xA000, 3), (0xAC00, 10), (0xD7B0, 3))
_KINDS = 11
# Sample sentences of each language; the first is the first article of the Universal Declaration of Human Rights.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. "
          "According to the table on this page the value was higher than in the year before. We could not find the answer to the question, because the text does not say how much it was. What did the report show, and where is the number given? "
          "I am sorry, but I cannot help you with this. Please send more pages or look at another part of the document. It has not been possible to confirm that, and I would not like to guess. We know only what is written here; nothing else can be read or determined from these lines.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. "
          "Nach der Tabelle auf dieser Seite war der Wert höher als im Jahr davor. Wir konnten die Antwort auf die Frage nicht finden, weil der Text nicht sagt, wie viel es war. Was hat der Bericht gezeigt, und wo ist die Zahl angegeben? "
          "Es tut mir leid, aber ich kann Ihnen dabei nicht helfen. Bitte senden Sie mehr Seiten oder sehen Sie in einem anderen Teil des Dokuments nach. Es ist nicht möglich gewesen, das zu bestätigen, und ich möchte nicht raten. Wir wissen nur, was hier steht; mehr lässt sich aus diesen Zeilen nicht lesen oder ermitteln, und die Frage lässt sich so nicht beantworten.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. "
          "D'après le tableau de cette page la valeur était plus élevée que l'année d'avant. Nous n'avons pas pu trouver la réponse à la question, car le texte ne dit pas combien c'était. Qu'a montré le rapport, et où le nombre est-il donné ? "
          "Je suis désolé, mais je ne peux pas vous aider. Merci d'envoyer plus de pages ou de regarder dans une autre partie du document. Il n'a pas été possible de confirmer cela, et je ne voudrais pas deviner. Nous savons seulement ce qui est écrit ici ; on ne peut rien lire ni déterminer d'autre avec ces lignes, et je ne suis pas capable de répondre.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. "
          "Según la tabla de esta página el valor fue más alto que en el año anterior. No pudimos encontrar la respuesta a la pregunta, porque el texto no dice cuánto era. ¿Qué mostró el informe, y dónde se da el número? "
          "Lo siento, pero no puedo ayudarle con eso. Envíe más páginas, por favor, o busque en otra parte del documento. No ha sido posible confirmar ese dato, y no quiero adivinar. Sabemos solo lo que está escrito aquí; no se puede leer ni determinar nada más con estas líneas, y no soy capaz de responder.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. "
          "Secondo la tabella di questa pagina il valore era più alto che nell'anno precedente. Non abbiamo potuto trovare la risposta alla domanda, perché il testo non dice quanto fosse. Che cosa ha mostrato la relazione, e dove è indicato il numero della società? Il consiglio ha approvato la spesa per gli uffici e per le nuove linee, ma non è stato possibile sapere quali. "
          "Mi dispiace, ma non posso aiutarla in questo. Si prega di inviare altre pagine o di guardare in un'altra parte del documento. Non è stato possibile confermare questo dato, e non vorrei indovinare. Sappiamo solo ciò che è scritto qui.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. "
          "Segundo a tabela desta página o valor foi mais alto do que no ano anterior. Não conseguimos encontrar a resposta à pergunta, porque o texto não diz quanto era. O que mostrou o relatório, e onde é dado o número da empresa? O conselho aprovou a despesa para os escritórios e as novas linhas, mas não foi possível saber quais são. "
          "Sinto muito, mas não posso ajudar com isso. Por favor, envie mais páginas ou veja outra parte do documento. Não foi possível confirmar esse dado, e não quero adivinhar. Sabemos apenas o que está escrito aqui.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. "
          "Volgens de tabel op deze bladzijde was de waarde hoger dan in het jaar daarvoor. Wij konden het antwoord op de vraag niet vinden, omdat de tekst niet zegt hoeveel het was. Wat heeft het verslag laten zien, en waar staat het getal? De raad heeft de kosten voor het kantoor en de nieuwe lijnen goedgekeurd. "
          "Het spijt me, maar ik kan u daar niet mee helpen. Stuur alstublieft meer bladzijden of kijk in een ander deel van het document. Het was niet mogelijk dat te bevestigen, en ik wil niet raden. Wij weten alleen wat hier staat.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. "
          "Enligt tabellen på den här sidan var värdet högre än året innan. Vi kunde inte hitta svaret på frågan, eftersom texten inte säger hur mycket det var. Vad visade rapporten, och var anges talet?",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. "
          "Ifølge tabellen på denne side var værdien højere end året før. Vi kunne ikke finde svaret på spørgsmålet, fordi teksten ikke siger, hvor meget det var. Hvad viste rapporten, og hvor er tallet angivet?",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
          "Według tabeli na tej stronie wartość była wyższa niż w roku poprzednim. Nie mogliśmy znaleźć odpowiedzi na pytanie, ponieważ tekst nie mówi, ile to było. Co pokazał raport i gdzie podano liczbę? Rada zatwierdziła wydatki na biura oraz nowe linie.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. "
          "Podle tabulky na této stránce byla hodnota vyšší než v předchozím roce. Odpověď na otázku jsme nemohli najít, protože text neříká, kolik to bylo. Co ukázala zpráva a kde je číslo uvedeno?",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. "
          "Potrivit tabelului de pe această pagină valoarea a fost mai mare decât în anul precedent. Nu am putut găsi răspunsul la întrebare, pentru că textul nu spune cât a fost.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. "
          "Az ezen az oldalon lévő táblázat szerint az érték magasabb volt, mint az előző évben. Nem találtuk meg a választ a kérdésre, mert a szöveg nem mondja meg, mennyi volt.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
          "Tämän sivun taulukon mukaan arvo oli korkeampi kuin edellisenä vuonna. Emme löytäneet vastausta kysymykseen, koska teksti ei kerro, kuinka paljon se oli.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. "
          "Bu sayfadaki tabloya göre değer bir önceki yıldan daha yüksekti. Sorunun cevabını bulamadık, çünkü metin bunun ne kadar olduğunu söylemiyor.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. "
          "Menurut tabel pada halaman ini nilainya lebih tinggi daripada tahun sebelumnya. Kami tidak dapat menemukan jawaban atas pertanyaan itu, karena teks tidak mengatakan berapa.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. "
          "Theo bảng trên trang này giá trị cao hơn năm trước. Chúng tôi không tìm thấy câu trả lời vì văn bản không nói là bao nhiêu.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. "
          "По данным таблицы на этой странице значение было выше, чем в предыдущем году. Мы не смогли найти ответ на вопрос, потому что в тексте не сказано, сколько это было. "
          "К сожалению, я не могу вам помочь. Пришлите больше страниц или посмотрите в другой части документа. Подтвердить это не удалось.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. "
          "За даними таблиці на цій сторінці значення було вищим, ніж у попередньому році. Ми не змогли знайти відповідь на питання, тому що в тексті не сказано, скільки це було.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. "
          "Σύμφωνα με τον πίνακα αυτής της σελίδας η τιμή ήταν υψηλότερη από το προηγούμενο έτος. Δεν βρήκαμε την απάντηση στην ερώτηση, γιατί το κείμενο δεν λέει πόσο ήταν. "
          "Λυπάμαι, αλλά δεν μπορώ να σας βοηθήσω. Στείλτε περισσότερες σελίδες ή δείτε σε άλλο μέρος του εγγράφου.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。"
          "このページの表によると、値は前の年より高かった。質問の答えは見つかりませんでした。報告は何を示したか。 "
          "申し訳ありませんが、お手伝いできません。ほかのページを送ってください。この文書では確認できませんでした。",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。"
          "根据本页的表格，该数值高于前一年。我们没有找到这个问题的答案，因为文中没有说明是多少。报告显示了什么，数字在哪里给出？请看下一页的图，公司在二月批准了新的预算，共有五百人参加。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. "
          "이 쪽의 표에 따르면 값은 전년보다 높았다. 질문에 대한 답을 찾을 수 없었다.",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. وفقا للجدول في هذه الصفحة كانت القيمة أعلى من العام السابق.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. לפי הטבלה בעמוד זה הערך היה גבוה מהשנה הקודמת.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। इस पृष्ठ की तालिका के अनुसार मान पिछले वर्ष से अधिक था।",
}
NAMES = tuple(SAMPLES)
LATIN = frozenset(("en", "de", "fr", "es", "it", "pt", "nl", "sv", "da", "pl", "cs", "ro", "hu", "fi", "tr", "id", "vi"))


@cache
def _script_table() -> np.ndarray:
    table = np.full(0x110000, 3, np.uint8)
    for (a, kind), (b, _) in zip(_SCRIPTS, (*_SCRIPTS[1:], (0xFF00, 0))):
        table[a:b] = kind
    return table


def words(text: str) -> list[str]:
    """The words that tell a language."""
    if len(text) > 8 and text.isupper():
        text = text.lower()
    return [w for w in _WORDS.findall(text) if not w[0].isupper()]


def _grams(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, index of the word of each) of the n-grams and scripts of words, words rising."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in ws).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in ws), np.int64, len(ws))
    word = np.repeat(np.arange(len(ws)), sizes)
    wide = codes.astype(np.uint64) + np.uint64(1)
    inner = (codes != 2) & (codes != 3)
    with np.errstate(over="ignore"):
        one = wide * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] * np.uint64(31) + wide[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] * np.uint64(31) + wide[2:] * np.uint64(0x165667B19E3779F9)
    in2, in3 = word[:-1] == word[1:], word[:-2] == word[2:]
    h = np.concatenate([one[inner], two[in2], three[in3]])
    at = np.concatenate([word[inner], word[:-1][in2], word[:-2][in3], word[inner]])
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    slots = np.concatenate([((h >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64), SLOTS + _script_table()[codes[inner]].astype(np.int64)])
    order = np.argsort(at, kind="stable")
    return slots[order], at[order]


def _counted(ws: list[str]) -> np.ndarray:
    return np.bincount(_grams(ws)[0], minlength=SLOTS + _KINDS).astype(float) if ws else np.zeros(SLOTS + _KINDS)


@cache
def _samples() -> np.ndarray:
    return np.stack([_counted(words(t)) for t in SAMPLES.values()], axis=1)


@dataclass
class Languages:
    """Log shares of each n-gram slot in each language over the background. counts: slots x languages of a corpus; texts: how many of each were learned."""

    counts: np.ndarray | None = None
    texts: np.ndarray | None = None
    rows: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        texts = np.zeros(len(NAMES)) if self.texts is None else self.texts
        samples = _samples()
        mean = (samples / samples.sum(axis=0)).mean(axis=1, keepdims=True)
        corpus = None if self.counts is None else self.counts**DAMPED  # frequent n-grams of a narrow corpus count less
        if corpus is not None:
            mean = mean / 2 + (corpus / np.maximum(corpus.sum(axis=0), 1)).mean(axis=1, keepdims=True) / 2
        mean = (mean + 1e-7) / (mean + 1e-7).sum()
        own = (samples + WEIGHT * mean) / (samples.sum(axis=0) + WEIGHT)
        if corpus is not None:
            there = (corpus + WEIGHT * mean) / (corpus.sum(axis=0) + WEIGHT)
            own = np.where(corpus.sum(axis=0) > 0, SAMPLED * own + (1 - SAMPLED) * there, own)
        self.table = np.log(((1 - FLOOR) * own + FLOOR * mean) / mean).astype(np.float32)
        self.prior = np.log((texts + 10) / (texts.sum() + 10 * len(texts)))
        self.known = np.zeros((0, len(NAMES)), np.float32)

    def __getstate__(self) -> dict:
        return {"table": self.table, "prior": self.prior}  # what tasks need

    def __setstate__(self, state: dict) -> None:
        self.counts = self.texts = None
        self.table, self.prior = state["table"], state["prior"]
        self.rows, self.known = {}, np.zeros((0, len(NAMES)), np.float32)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log score of each language, letters of the words that tell) of each text."""
        if len(self.rows) > 300_000:
            self.rows, self.known = {}, self.known[:0]
        found = [words(t) for t in texts]
        new = [*{w for ws in found for w in ws if w not in self.rows}]
        if new:
            made = []
            for a, b in slices(new, 300_000):
                slots, at = _grams(new[a:b])
                made.append(np.add.reduceat(self.table[slots], np.searchsorted(at, np.arange(b - a)), axis=0))
            self.rows.update((w, len(self.known) + i) for i, w in enumerate(new))
            self.known = np.concatenate([self.known, *made])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((self.rows[w] for ws in found for w in ws), np.int64, int(sizes.sum()))
        out = np.tile(self.prior, (len(texts), 1))
        full = np.nonzero(sizes)[0]
        if len(full):
            out[full] += np.add.reduceat(self.known[ids], (np.cumsum(sizes) - sizes)[full], axis=0)
        return out, np.fromiter((sum(map(len, ws)) for ws in found), np.int64, len(found))

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or '', scores, letters) of each text."""
        if not texts:
            return [], np.zeros((0, len(NAMES))), np.zeros(0, np.int64)
        s, letters = self.scores(texts)
        best = s.argmax(axis=1)
        top = np.partition(s, -2, axis=1)
        sure = top[:, -1] - top[:, -2] >= LEAD + SHORT / np.maximum(letters, 1)
        out = []
        for k, ok, n in zip(best, sure, letters):
            name = NAMES[k]
            out.append(name if ok and n >= (LETTERS if name in LATIN else LETTERS_OTHER) else "")
        return out, s, letters

    def language(self, text: str) -> str:
        return self.judge([text])[0][0]


@cache
def sampled() -> Languages:
    """The model of the sample sentences alone."""
    return Languages()


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """The model of the samples and of all labelled texts of df."""
    label = F.lower(F.regexp_extract(F.trim(F.col(f"`{lang}`").cast("string")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    rows = df.select(F.col(f"`{text}`").cast("string").alias("t"), label.alias("l")).filter(F.col("l").isin(*NAMES) & F.col("t").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(NAMES), SLOTS + _KINDS))
        texts = np.zeros(len(NAMES))
        for pdf in batches:
            for name, part in pdf.groupby("l")["t"]:
                k = NAMES.index(name)
                ts = part.tolist()
                texts[k] += len(ts)
                for a, b in slices(ts, 300_000):
                    total[k] += _counted([w for t in ts[a:b] for w in words(t)])
        k, slot = np.nonzero(total)
        yield pd.DataFrame({"k": [*k, *range(len(NAMES))], "slot": [*slot, *[-1] * len(NAMES)], "n": [*total[k, slot], *texts]})

    # at most languages x slots rows
    found = rows.mapInPandas(count, "k int, slot int, n double").groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts, texts = np.zeros((SLOTS + _KINDS, len(NAMES))), np.zeros(len(NAMES))
    for k, slot, n in zip(found["k"], found["slot"], found["n"]):
        if slot < 0:
            texts[k] = n
        else:
            counts[slot, k] += n
    return Languages(counts, texts)
