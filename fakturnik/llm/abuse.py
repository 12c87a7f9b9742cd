"""Abusive, hateful, threatening or sexual passages: a character n-gram linear classifier.

The features of a sentence are its character n-grams of two to five signs, hashed, taken from the text
with letter case, accents and common disguises removed. They are scaled by naive Bayes log-count ratios,
and a logistic regression is fitted over the scaled features. A document scores as its worst sentence.

Training reads labelled documents (a bounded sample of at most LABELLED, chosen by a hash of the id, with
at most TRAIN_LENGTH signs each) and the seed sentences below. A label says that a document holds at least
one such passage, not where. The documents form FOLDS parts; in rounds, the sentences of positive documents
that the model of the other parts rates as abusive become the positive sentences. Sentences of negative
documents and harmless seeds stay negative, and so does a sentence that positive documents hold no oftener
than all documents do, by counts over the whole corpus. The threshold is the one that errs least over the
documents which a model has not seen. Scoring covers every sentence of every document.

Defined cases: null, empty and blank texts score 0; documents without a label are only scored; several
labels of a document are averaged, and a tie leaves it out of training; without any label the seeds alone
are the training set; repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Labelled documents used for training at most; sentences of negative documents used at most.
LABELLED, NEGATIVES = 5_000, 15_000
BITS = 18
THRESHOLD = 0.5
ROUNDS, FOLDS, LIGHT, LIFT = 3, 3, 0.3, 30.0

FOLD = str.maketrans("ąćęłńóśźżäöüßéèêàáâíìîñçšžčřý", "acelnoszzaouséèêaaaiiincszcry".replace("é", "e").replace("è", "e").replace("ê", "e"))
LATIN = re.compile("[a-z]")
LEET = str.maketrans("@013457$!", "aoieastsi")

#: Seed sentences for training, one per line: a passage that must be found, or a harmless one that sounds alike.
ABUSIVE = """ty idioto, zaplacisz mi za to
jestescie banda debili i zlodziei
spierdalaj ode mnie z tymi fakturami
wypierdalaj stad, gnoju
jebac wasza firme i was wszystkich
pierdol sie, kretynie
ty glupia kurwo, oddawaj pieniadze
zdechnij, smieciu
znajde cie i polamie ci nogi
spale wam ten zaklad razem z wami
zabije cie, jesli jeszcze raz zadzwonisz
ty stara szmato, nic nie umiesz
ksiegowa to zwykla dziwka
pokaz mi swoje cycki, suczko
wyslij mi nagie zdjecia zamiast umowy
chetnie bym ja zerznal
tacy jak wy to podludzie i powinni zniknac
takich smieci trzeba wytepic
won z naszego kraju, brudasy
pocaluj mnie w dupe, frajerze
chuj wam w dupe
skonczony debil, parszywa swinia
fuck you and your company
you stupid bitch, you will pay for this
you are worthless trash and should die
i will find you and kill you
i hope you choke, you bastard
people like them are vermin and must be wiped out
send me nudes, sweetie
i would love to bang her on that desk
go back to your country, you filthy animals
piece of shit moron
du verdammter idiot, verpiss dich
ihr arschlocher bekommt nichts von mir
ich finde dich und breche dir die knochen
so ein abschaum gehort ausgerottet
halt die fresse, du hure
zeig mir deine titten
k*rwa, co za ch*je
you f***ing a**hole
j.e.b.a.c was wszystkich
s z m a t o, oddaj pieniadze
idiota z ciebie i nieudacznik
co za kretyni tam pracuja
zamknij morde, glupku
zamknij ryj, cwelu
ty parszywy gnojku, nienawidze cie
jestes nikim, zwyklym zerem i smieciem
ale z ciebie tepa dzida i pizda
odpierdol sie ode mnie raz na zawsze
w dupie mam twoje pretensje, palancie
pierdolony zlodziej i oszust
rozwale ci leb, jak cie spotkam
dostaniesz w morde, obiecuje ci to
wiem, gdzie mieszkasz, i przyjde po ciebie
poderzne ci gardlo, zobaczysz
zaluje, ze cie matka nie wyskrobala
obys zdechl w meczarniach
mam nadzieje, ze zgnijesz w wiezieniu
powies sie, nikt nie bedzie plakal
wysadze wasze biuro w powietrze
zabijemy was wszystkich, psy
twoje dzieci tego pozaluja
cyganie to sami zlodzieje, trzeba ich wygonic
zydzi do gazu
ciapaci won do siebie
pedaly powinny siedziec w wiezieniu
baby nadaja sie tylko do garow i do lozka
rozbieraj sie, mala, i pokaz cipke
zrobisz mi loda, to zaplace
mam ochote cie przeleciec od tylu
jaki masz rozmiar stanika, cukiereczku
masturbuje sie, myslac o tobie
przyslij fotki bez ubrania, ksiezniczko
shut up, you dumb cow
you are a pathetic loser and a liar
go to hell, asshole
what a bunch of retards
nobody would miss you if you were dead
kill yourself, you pig
i am going to beat you until you bleed
i will burn your house down with you inside
watch your back, we know where your kids go to school
these foreigners are parasites, throw them all out
all of them are subhuman scum
women like her belong in the kitchen and in bed
i want to see your tits, baby
suck my dick, you whore
spread your legs and we can talk about the price
i masturbate thinking about you
du bist ein wertloses stuck scheisse
ihr seid doch alle vollidioten und betruger
leck mich am arsch, du penner
ich bringe dich um, du schwein
ich schlage dir die zahne ein
auslander raus, dieses pack gehort vergast
schick mir nacktfotos, susse
ich wurde dich gern mal ficken"""
HARMLESS = """szkolenie o przeciwdzialaniu molestowaniu i mobbingowi w pracy
szmaty i sciereczki do mycia podlogi
swinie rzezne i bydlo, cena za kilogram zywej wagi
suka hodowlana, szczepienie i odrobaczenie
pedal hamulca i pedal gazu do wymiany
kurtyna przeciwpozarowa i kurtyna teatralna
badanie piersi i wizyta u seksuologa w pakiecie medycznym
srodek na karaluchy i szczury, zagazowac komore
zabic deski gwozdziami i spalic odpady drewniane w piecu
usuwanie smieci raz w tygodniu
manekin damski z biustem do bielizny
dupleks hydrauliczny i pala gumowa
regulamin zabrania obelg i grozb wobec pracownikow
the cockpit cover and the breast pump were delivered
please kill the process before the update
dick smith signed the delivery note in essex
pest control will wipe out the vermin in the store
the bastard file and the cock valve are on the pallet
sex education materials for schools, 20 copies
der dickdarm und die brustuntersuchung sind im paket enthalten
schlachtschweine und rinder, preis pro kilogramm
ratten und schadlinge werden in der halle bekampft
prosimy o pilna zaplate zaleglej faktury
kto podpisal ten protokol odbioru
przesylke odeslano do magazynu glownego
we ask you to pay the invoice within 14 days
bitte zahlen sie die rechnung innerhalb von 14 tagen
zabijak stada i byk hodowlany
gazowanie komory przechowalniczej owocow
prosze zamknac drzwi i wylaczyc swiatlo
rozbior budynku i wywoz gruzu
morderczy wyscig z terminem dostawy zakonczony
uderzenie mlota spalinowego, naprawa glowicy
lozko drewniane z materacem i szafka
rozebranie rusztowania przed odbiorem
gole przewody zabezpieczyc tasma izolacyjna
nagi drut miedziany w kregach
suczka rasy jamnik, badanie weterynaryjne
krowy mleczne i cielaki, rachunek za pasze
szczur wodny, deratyzacja piwnicy
glupi blad w systemie zostal poprawiony
psy strozujace, karma sucha 15 kg
spotkamy sie w biurze w piatek o dziewiatej
nasza umowa nie obejmuje serwisu kotla
termin platnosci minal, wzywamy do zaplaty pod rygorem skierowania sprawy do sadu
w razie braku zaplaty skierujemy sprawe do windykacji
we will take legal action if the amount is not paid
please find attached the minutes of the meeting
the dead line was cut and the live wire was covered
naked cable ends must be insulated
bastard pine and bitch chisel, two pieces
chicken breast, pork butt and rump steak
the train killed its engine at the station
wir werden rechtliche schritte einleiten
nackte drahte mussen isoliert werden
die hundin wurde geimpft und gechippt
der esel und das schwein werden am freitag geliefert"""

SPEAKER = re.compile(r"^\[[^\]\n]+\] ?[^\s:]+: ?", re.M)
SENTENCE = re.compile(r"(?<=[.!?…])\s+|[\n\r  ]+")
SPELLED = re.compile(r"(?<!\w)\w([ .\-_*])\w(?:\1\w){2,}(?!\w)")
DISGUISED = re.compile(r"(?<!\S)[\"'(„]*(?=\S*[a-z]\S*[a-z])[a-z@0-9$*#](?:[a-z@0-9$!*#]+)[a-z@0-9$*#](?=[.,;:?!)\"'”]*(?!\S))")


REPEATED, NUMBER = re.compile(r"([a-z])\1{2,}"), re.compile("[0-9]+")
#: Where a disguised word can be.
MASKED = re.compile(r"[a-z][@0-9$!*#]|[@0-9$!*#][a-z]")


def normal(text: str) -> str:
    """Small letters without accents, spelled-out words joined, digits and signs inside words as letters, numbers as 9."""
    s = (SPEAKER.sub("", text) if "[" in text else text).lower().translate(FOLD)
    s = SPELLED.sub(lambda m: re.sub(r"[^\w]", "", m[0]) if not re.search(r"\d", m[0]) else m[0], s)

    def open_up(m: re.Match) -> str:
        w = m[0]
        return w.translate(LEET).replace("9", "*").replace("6", "*").replace("8", "*") if sum(c.isdigit() for c in w) <= 2 else w

    if MASKED.search(s):
        s = DISGUISED.sub(open_up, s)
    s = REPEATED.sub(r"\1", s)
    return NUMBER.sub("9", s)


def abusive_seeds() -> list[str]:
    return [normal(s) for s in ABUSIVE.split("\n")]


def harmless_seeds() -> list[str]:
    return [normal(s) for s in HARMLESS.split("\n")]


def sentences(text: str | None) -> list[str]:
    """The sentences of a text in normal form; those with fewer than three Latin letters carry no features."""
    return [p for s in SENTENCE.split(text or "") if len(re.findall("[a-z]", p := normal(s).strip())) > 2]


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sentence number, hashed n-gram) of all n-grams of the sentences, in one pass over one array."""
    joined = "".join(f" {p} \0" for p in parts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 0) - (codes == 0)
    rows, feats = [], []
    h, ok = np.zeros(len(codes), dtype=np.uint64), np.ones(len(codes), dtype=bool)
    for n in range(1, 6):
        at = np.zeros(len(codes), dtype=np.uint64)
        at[: len(codes) - n + 1] = codes[n - 1 :]
        ok &= at != 0
        h = (h * np.uint64(1_000_003) + at * np.uint64(2_654_435_761)) & np.uint64(0xFFFFFFFFFFFF)
        if n >= 2:
            mixed = (h ^ (h >> np.uint64(17))) * np.uint64(0x9E3779B1)
            feats.append(((mixed >> np.uint64(11)) & np.uint64((1 << BITS) - 1))[ok].astype(np.int64))
            rows.append(owner[ok])
    return np.concatenate(rows), np.concatenate(feats)


class Grams:
    """The n-grams of sentences: which sentence, which feature."""

    def __init__(self, parts: list[str]):
        self.size = len(parts)
        self.rows, self.feats = grams(parts) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def only(self, keep: np.ndarray) -> Grams:
        """The chosen sentences, in the same order."""
        out = Grams([])
        there = keep[self.rows]
        out.size, out.rows, out.feats = int(keep.sum()), (np.cumsum(keep) - 1)[self.rows[there]], self.feats[there]
        return out


class Model:
    """Weights over hashed n-grams (ratio times coefficient), a bias, and the rating from which a sentence counts."""

    def __init__(self, weights: np.ndarray, bias: float, threshold: float = THRESHOLD, held_out: tuple[int, int, int] = (0, 0, 0)):
        self.weights, self.bias, self.threshold, self.held_out = weights.astype(np.float32), float(bias), float(threshold), held_out

    def rate(self, parts: list[str]) -> np.ndarray:
        return self.rate_grams(Grams(parts))

    def rate_grams(self, g: Grams) -> np.ndarray:
        z = np.bincount(g.rows, weights=self.weights[g.feats], minlength=g.size) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, rating: np.ndarray) -> np.ndarray:
        """Ratings moved along the log odds so that the threshold comes to one half."""
        r = np.clip(rating, 1e-9, 1 - 1e-9)
        odds = np.log(r / (1 - r)) - np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-odds))


def fit(g: Grams, y: np.ndarray, weight: np.ndarray, rounds: int = 45, l2: float = 2e-4) -> Model:
    """Logistic regression over n-grams scaled by naive Bayes log-count ratios, by gradient steps with a step size per feature.

    The labels may lie between 0 and 1.
    """
    d, w = 1 << BITS, weight / weight.sum()
    p = 1 + np.bincount(g.feats, weights=(y * weight)[g.rows], minlength=d)
    q = 1 + np.bincount(g.feats, weights=((1 - y) * weight)[g.rows], minlength=d)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    known, feats = np.unique(g.feats, return_inverse=True)
    scale, n = ratio[known][feats], len(known)
    beta, bias, m, v = np.zeros(n), 0.0, np.zeros(n), np.zeros(n)
    mb = vb = 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(g.rows, weights=beta[feats] * scale, minlength=g.size) + bias
        err = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        step = np.bincount(feats, weights=err[g.rows] * scale, minlength=n) + l2 * beta
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * step, 0.99 * v + 0.01 * step * step
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        beta -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(d)
    weights[known] = beta * ratio[known]
    return Model(weights, bias)


def train(labelled: list[tuple[str, float]], common: dict[str, float] | None = None) -> Model:
    """The model from (text, mean label) pairs and the seeds; labels say only that a passage is somewhere in the text.

    ``common`` gives the share of all documents that hold a sentence (in normal form). A sentence that stands in
    positive documents no oftener than its share foretells is harmless, whatever else speaks for it.

    Every labelled document belongs to one of FOLDS parts and is rated only by the model of the other parts.
    Sentences of negative documents stay negative throughout, as do the harmless seeds; a reviewer's slip is
    outweighed by the sides on which a sentence stands elsewhere. At first every further sentence of a positive
    document counts lightly as positive, then only those that the model of the other parts rates above the
    threshold that errs least over the documents it has not seen. The last such threshold is the model's.
    """
    seen = [(list(dict.fromkeys(sentences(t))), y > 0.5) for t, y in labelled]
    in_bad, in_good = Counter(s for b, bad in seen if bad for s in b), Counter(s for b, bad in seen if not bad for s in b)
    seeds, calm = abusive_seeds(), harmless_seeds()
    # Reviewers err, so a sentence goes with the side on which it stands more often; the commonest harmless ones come first.
    good = sorted((s for s in in_good if in_good[s] >= in_bad[s]), key=lambda s: (-in_good[s], s))[:NEGATIVES]
    parts = [(i % FOLDS, bad, [s for s in b if not bad or in_bad[s] > in_good[s]]) for i, (b, bad) in enumerate(seen)]
    texts = list(dict.fromkeys([*seeds, *calm, *good, *(s for _, _, b in parts for s in b)]))
    number = {s: i for i, s in enumerate(texts)}
    g = Grams(texts)
    ids = [(f, bad, np.array([number[s] for s in b], dtype=np.int64)) for f, bad, b in parts]
    folds = np.zeros((FOLDS, g.size), dtype=bool)  # in which parts a sentence stands
    for f, _, b in ids:
        folds[f, b] = True
    is_good, is_seed = np.zeros(g.size, dtype=bool), np.zeros(g.size, dtype=bool)
    is_good[[number[s] for s in good]] = True
    is_seed[[number[s] for s in seeds]] = True
    is_calm = np.zeros(g.size, dtype=bool)
    is_calm[[number[s] for s in calm]] = True
    bad_docs, share = np.array([in_bad[s] for s in texts], dtype=float), np.array([(common or {}).get(s, 0.0) for s in texts])
    foretold = sum(bad for _, bad in seen) * share  # positive documents that would hold the sentence by its share of all documents
    # How much oftener positive documents hold a passage than all documents do: known from the sentences that the seeds alone find.
    keep = is_good | is_calm | is_seed
    plain = fit(g.only(keep), (is_seed & ~is_calm)[keep].astype(float), np.where(is_seed, max(1.0, keep.sum() / is_seed.sum() / 4), 1.0)[keep])
    sure = (bad_docs > 0) & ~is_good & (share > 0) & (plain.rate_grams(g) > 0.9)
    lift = float(np.clip(bad_docs[sure].sum() / max(1e-9, foretold[sure].sum()) / 2, 1.5, LIFT)) if sure.any() else 1.5
    # A sentence is usual if its positive documents are likelier as many as foretold than ``lift`` times as many.
    is_good |= (share > 0) & (bad_docs > 0) & (bad_docs * np.log(lift) < (lift - 1) * foretold)
    often = np.where(is_good, np.maximum([in_good[s] for s in texts], bad_docs), 0)
    # What the sentences of positive documents count as: 1 positive, 0 harmless, -1 left out.
    label, light = np.full(g.size, 1), LIGHT

    def fitted(out: int | None) -> Model:
        inside = folds.any(axis=0) if out is None else np.delete(folds, out, axis=0).any(axis=0)
        known = inside & ~is_good
        y = (is_seed | known & (label == 1)) & ~is_calm
        weight = np.where(known & (label == 1), light, 0.0) + (known & (label == 0))
        weight = np.where(is_good & inside, np.sqrt(np.maximum(often, 1)), weight)
        weight = np.where(is_calm, np.maximum(weight, 2.0), np.where(is_seed, 1.0, weight))
        keep = weight > 0
        even = max(1.0, (weight * ~y).sum() / max(1, (y & keep).sum()) / 4)
        return fit(g.only(keep), y[keep].astype(float), (weight * np.where(y, even, 1.0))[keep])

    rating, limit, held = np.zeros(g.size), THRESHOLD, (0, 0, 0)
    for _ in range(ROUNDS):
        worst: list[tuple[float, bool]] = []
        rating[:] = 0
        for f in range(FOLDS):
            r = np.zeros(g.size)
            r[folds[f]] = fitted(f).rate_grams(g.only(folds[f]))
            worst += [(float(r[b].max(initial=0)), bad) for k, bad, b in ids if k == f]
            rating = np.maximum(rating, r)
        limit, held = best_threshold(worst)
        label, light = np.where(rating > max(limit, THRESHOLD), 1, np.where(rating < 0.3, 0, -1)), 1.0
    final = fitted(None)
    final.threshold, final.held_out = limit, held
    return final


def best_threshold(worst: list[tuple[float, bool]]) -> tuple[float, tuple[int, int, int]]:
    """The threshold from one half up of least errors over held-out documents, the lowest of equals; and (right, found, positive) there."""
    options = [round(THRESHOLD + 0.02 * k, 2) for k in range(21)]
    errors = {o: sum((r > o) != bad for r, bad in worst) for o in options}
    best = min(options, key=lambda o: (errors[o], abs(o - THRESHOLD)))
    hit = [(r > best, bad) for r, bad in worst]
    return best, (sum(a and b for a, b in hit), sum(a for a, _ in hit), sum(b for _, b in hit))


#: Signs after which a text is too long to train on (it is scored all the same).
TRAIN_LENGTH = 20_000


def _pieces(text: Column) -> Column:
    """The sentences of a text, small and with numbers as 9: keys under which they are counted."""
    flat = F.regexp_replace(F.lower(text), "[0-9]+", "9")
    return F.array_distinct(F.filter(F.split(flat, r"(?<=[.!?…])\s+|[\n\r\u2028\u2029]+"), lambda x: F.length(x) > 2))


def shares(documents: DataFrame, sample: DataFrame) -> dict[str, float]:
    """For every sentence of the sampled documents (as normal form) the share of all documents that hold it.

    The sample is bounded, so its keys are; all documents are counted against them in one pass whose counts
    combine before the shuffle.
    """
    keys = sample.select(F.explode(_pieces(F.col("text"))).alias("piece")).distinct().withColumn("key", F.xxhash64("piece"))
    every = documents.filter("text IS NOT NULL").select(F.explode(_pieces(F.col("text"))).alias("piece")).select(F.xxhash64("piece").alias("key"))
    counts = every.join(F.broadcast(keys.select("key").distinct()), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = max(1, documents.count())
    out: Counter = Counter()
    for r in keys.join(counts, "key").select("piece", "n").collect():
        out[normal(r["piece"]).strip()] += r["n"]
    return {s: n / total for s, n in out.items()}


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents, at most LABELLED of them with at most TRAIN_LENGTH signs each."""
    mean = labels.filter("abusive IN (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.avg("abusive").alias("y")).filter("y <> 0.5")
    chosen = mean.orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    short = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= TRAIN_LENGTH))
    sample = cut(short.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("text", "y").distinct(), "labelled")
    pairs = sorted((r["text"], float(r["y"])) for r in sample.collect())
    return train(pairs, shares(documents, sample)) if pairs else train([])


#: Different sentences that a worker remembers with their normal form, and signs of new sentences rated in one pass.
REMEMBERED, RATED = 100_000, 500_000


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score): how surely the worst sentence of a document is abusive, over one half if it counts as such."""
    model = learn(documents, labels)
    sent = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.threshold))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rater, known = Model(*sent.value), {}  # sentence as it stands: its rating

        def rate(new: list[str]) -> None:
            forms = [normal(x).strip() for x in new]
            there = [i for i, f in enumerate(forms) if len(LATIN.findall(f)) > 2]
            r = np.zeros(len(new))
            r[there] = rater.score(rater.rate([forms[i] for i in there]))
            known.update(zip(new, r.tolist(), strict=True))

        for pdf in batches:
            if len(known) > REMEMBERED:
                known.clear()
            texts = [list(dict.fromkeys(SENTENCE.split(text or ""))) for text in pdf["text"]]
            waiting, size = {}, 0
            for parts in texts:
                for s in parts:
                    if s not in known and s not in waiting:
                        waiting[s] = None
                        size += len(s)
                if size > RATED:
                    rate(list(waiting))
                    waiting, size = {}, 0
            rate(list(waiting))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.round([max((known[s] for s in parts), default=0.0) for parts in texts], 6)})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, score double")


def source_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source: documents, how many score as abusive, their share and the mean score."""
    by_doc = documents.select("doc_id", "source").join(scores(documents, labels), "doc_id")
    flag = (F.col("score") > THRESHOLD).cast("int")
    return by_doc.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(flag).alias("abusive"), F.round(F.avg(flag), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
