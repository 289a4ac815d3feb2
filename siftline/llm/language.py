"""Language of documents and of their parts by compression.

Every segment of a text (a sentence or line) is compressed with zstandard against one
raw-content dictionary for each language; the language whose dictionary leaves the fewest
bytes is chosen, and the choice is rejected where the runner-up is too close. Dictionaries
hold seed prose, written below, and labelled sentences of the input itself: a bounded sample
of rows (``sample_rows``), of which a sentence counts only if the seed dictionaries agree
with its label, so wrong labels do not get in.

Defined cases: null and empty texts, and texts without a segment of ``min_words`` plain
words, have no language; segments whose margin is below ``min_margin`` have none either;
texts are read whole, whatever their length; repeated rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.labels import LANGUAGES, stated

#: Seed prose for each language: everyday sentences with its commonest words.
SEED = {
    "es": "Desde ayer el equipo no puede abrir la página y los clientes están muy cansados. Cuando llegamos a la oficina, nadie sabía por qué el servidor había dejado de funcionar. Según ellos, la factura sigue siendo la misma aunque el servicio es peor. Necesitamos ayuda para mover todos los datos antes del lunes. En esta semana hemos perdido mucho dinero y también tiempo. Pero el soporte dice que todo va bien, así que buscamos otra solución para nuestra empresa. Al revisar las cuentas vimos que faltaban varios pagos de este mes. Durante la noche se borraron los informes sin ninguna explicación. Hay que esperar hasta mañana porque el cliente pide una respuesta.",
    "pt": "Desde ontem a equipe não consegue abrir a página e os clientes estão muito cansados. Quando chegamos ao escritório, ninguém sabia por que o servidor tinha deixado de funcionar. Segundo eles, a fatura continua a mesma embora o serviço seja pior. Precisamos de ajuda para mover todos os dados antes da segunda. Nesta semana perdemos muito dinheiro e também tempo. Mas o suporte diz que tudo está bem, por isso procuramos outra solução para a nossa empresa. Ao revisar as contas vimos que faltavam vários pagamentos deste mês. Durante a noite os relatórios foram apagados sem nenhuma explicação. É preciso esperar até amanhã porque o cliente quer uma resposta.",
    "pl": "Od wczoraj zespół nie może otworzyć strony i klienci są już bardzo zmęczeni. Kiedy przyszliśmy do biura, nikt nie wiedział, dlaczego serwer przestał działać. Według nich rachunek jest taki sam, chociaż usługa jest gorsza. Potrzebujemy pomocy, żeby przenieść wszystkie dane przed poniedziałkiem. W tym tygodniu straciliśmy dużo pieniędzy i także czas. Ale wsparcie mówi, że wszystko jest w porządku, więc szukamy innego rozwiązania dla naszej firmy. Przy sprawdzaniu kont zobaczyliśmy, że brakuje kilku wypłat za ten miesiąc. W nocy raporty zostały usunięte bez żadnego wyjaśnienia. Trzeba czekać do jutra, bo klient chce odpowiedzi.",
    "de": "Seit gestern kann das Team die Seite nicht öffnen und die Kunden sind schon sehr müde. Als wir ins Büro kamen, wusste niemand, warum der Server nicht mehr lief. Nach ihrer Meinung bleibt die Rechnung gleich, obwohl der Dienst schlechter ist. Wir brauchen Hilfe, um alle Daten vor dem Montag zu verschieben. In dieser Woche haben wir viel Geld und auch Zeit verloren. Aber der Support sagt, dass alles in Ordnung ist, darum suchen wir eine andere Lösung für unsere Firma. Beim Prüfen der Konten sahen wir, dass mehrere Auszahlungen für diesen Monat fehlten. In der Nacht wurden die Berichte ohne jede Erklärung gelöscht. Man muss bis morgen warten, weil der Kunde eine Antwort will.",
    "fr": "Depuis hier l'équipe ne peut pas ouvrir la page et les clients sont déjà très fatigués. Quand nous sommes arrivés au bureau, personne ne savait pourquoi le serveur ne marchait plus. Selon eux, la facture reste la même alors que le service est moins bon. Nous avons besoin d'aide pour déplacer toutes les données avant lundi. Cette semaine nous avons perdu beaucoup d'argent et aussi du temps. Mais le support dit que tout va bien, donc nous cherchons une autre solution pour notre société. En relisant les comptes nous avons vu qu'il manquait plusieurs paiements du mois. Pendant la nuit les rapports ont été effacés sans aucune explication. Il faut attendre jusqu'à demain parce que le client veut une réponse.",
    "en": "Since yesterday the team has not been able to open the page and the clients are already very tired. When we came to the office, nobody knew why the server had stopped working. They say that the bill stays the same although the service is worse. We need some help to move all of our data before Monday. This week we have lost a lot of money and also time. But the support team says that everything is fine, so we are looking for another solution for our company. While checking the accounts we saw that several payouts for this month were missing. During the night the reports were deleted without any explanation. You have to wait until tomorrow because the client wants an answer.",
    "ru": "Со вчерашнего дня команда не может открыть страницу, и клиенты уже очень устали. Когда мы пришли в офис, никто не знал, почему сервер перестал работать. По их словам, счёт остаётся прежним, хотя сервис стал хуже. Нам нужна помощь, чтобы перенести все данные до понедельника. На этой неделе мы потеряли много денег и ещё время. Но поддержка говорит, что всё хорошо, поэтому мы ищем другое решение для нашей компании. При проверке счетов мы увидели, что не хватает нескольких выплат за этот месяц. Ночью отчёты были удалены без всякого объяснения. Надо ждать до завтра, потому что клиент хочет получить ответ.",
}

#: Seed prose of other languages in Cyrillic letters: what it fits better is none of the seven.
OTHERS = {
    "uk": "Від учора команда не може відкрити сторінку, і клієнти вже дуже втомилися. Коли ми прийшли до офісу, ніхто не знав, чому сервер перестав працювати. За їхніми словами, рахунок залишається таким самим, хоча сервіс став гіршим. Нам потрібна допомога, щоб перенести всі дані до понеділка. Цього тижня ми втратили багато грошей і ще час. Але підтримка каже, що все гаразд, тому ми шукаємо інше рішення для нашої компанії. Під час перевірки рахунків ми побачили, що бракує кількох виплат за цей місяць. Уночі звіти було видалено без жодного пояснення. Треба чекати до завтра, тому що клієнт хоче отримати відповідь.",
    "bg": "От вчера екипът не може да отвори страницата и клиентите вече са много уморени. Когато дойдохме в офиса, никой не знаеше защо сървърът е спрял да работи. Според тях сметката остава същата, въпреки че услугата е по-лоша. Имаме нужда от помощ, за да преместим всички данни преди понеделник. Тази седмица загубихме много пари и също време. Но поддръжката казва, че всичко е наред, затова търсим друго решение за нашата фирма. При проверката на сметките видяхме, че липсват няколко плащания за този месец. През нощта отчетите бяха изтрити без никакво обяснение. Трябва да се чака до утре, защото клиентът иска отговор.",
    "sr": "Од јуче тим не може да отвори страницу и клијенти су већ веома уморни. Када смо дошли у канцеларију, нико није знао зашто је сервер престао да ради. По њиховим речима рачун остаје исти, иако је услуга лошија. Треба нам помоћ да преместимо све податке пре понедељка. Ове недеље смо изгубили много новца и још времена. Али подршка каже да је све у реду, зато тражимо друго решење за нашу фирму. При провери рачуна видели смо да недостаје неколико исплата за овај месец. Током ноћи извештаји су обрисани без икаквог објашњења. Мора се чекати до сутра, јер клијент жели одговор.",
}
#: Bytes of a dictionary; more makes compression slower and adds little.
DICTIONARY_BYTES = 24_000
#: Rows, by order of a hash, that the labelled sentences are taken from.
SAMPLE_ROWS = 6_000
#: Plain words that a segment must have.
MIN_WORDS = 5
#: Margin from which a part is clearly of one language; longer parts below it may hold two.
CLEAR = 0.3
#: Places at which a part is tried to be cut at a time.
CUTS = 64
#: Share of the runner-up's size by which the best must be smaller.
MIN_MARGIN = 0.06
#: The same for parts of fewer than SHORT words, in which names and terms weigh more.
SHORT, SHORT_MARGIN = 10, 0.2

_TOKEN = regex.compile(r"\S+")
_PLAIN = regex.compile(r"[\p{Ps}\p{Pi}\"'«¿¡*]*([\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*)[\p{P}]*")
_END = regex.compile(r"(?<=[.!?…;])\s+|[\n\r ]+|\s[|=•–—]\s|(?<=[)\]/])\s+|[!?]+(?=\S)")


def segments(text: str) -> list[tuple[str, int]]:
    """Parts of a text that can be a sentence, with the number of their plain words.

    A part ends at sentence punctuation, a line break, a bracket that closes or a token that
    is no word (number, reference, link) if a capital letter follows. Only the plain words are
    kept: letters of any alphabet, no digits, at least two of them in lower case or all in
    capitals, so that names, references and contacts do not weigh.
    """
    out: list[tuple[str, int]] = []

    def close(words: list[str]) -> None:
        if len(words) >= 2:
            out.append((" ".join(words), len(words)))

    for part in _END.split(text):
        if not part:
            continue
        words: list[str] = []
        shout = part.isupper()
        odd = False
        for token in part.split():
            m = _PLAIN.fullmatch(token)
            if m is None:
                odd = True
                continue
            word = m[1]
            if word[0].isupper() and not shout:
                if odd and len(words) >= 3:
                    close(words)
                    words = []
                elif words and len(word) > 1 and not word.isupper():
                    odd = False
                    words.append(word)
                    continue
            odd = False
            words.append(word)
        close(words)
    return out


class Compressors:
    """One prepared zstandard dictionary for each language."""

    def __init__(self, prose: dict[str, str]) -> None:
        import zstandard

        def prepared(text: str):
            d = zstandard.ZstdCompressionDict(text.lower().encode()[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=1)
            return zstandard.ZstdCompressor(level=1, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        own = {lang: prepared(prose[lang]) for lang in LANGUAGES}
        self.latin = {lang: own[lang] for lang in LANGUAGES if lang != "ru"}
        self.cyrillic = {"ru": own["ru"], **{lang: prepared(text) for lang, text in OTHERS.items()}}

    def classify(self, parts: list[str], min_margin: float) -> list[tuple[str | None, float]]:
        """Language and confidence of each part, among the languages of the alphabet that most of its letters have.

        A part that a language outside the seven fits best, or whose margin is narrow, has none.
        """
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(parts)
        groups: tuple[list[int], list[int]] = ([], [])
        for i, p in enumerate(parts):
            cyr = 0 if p.isascii() else sum("Ѐ" <= ch <= "ӿ" for ch in p)
            groups[2 * cyr > len(p) - p.count(" ")].append(i)
        for packed, work in zip((self.latin, self.cyrillic), groups):
            encoded = [parts[i].lower().encode() for i in work]
            sizes = [[len(c.compress(b)) for b in encoded] for c in packed.values()]
            for n, i in enumerate(work):
                best, second = sorted((s[n] - 8, k) for s, k in zip(sizes, packed))[:2]
                margin = 1 - max(best[0], 1) / max(second[0], 1)
                least = max(min_margin, SHORT_MARGIN) if parts[i].count(" ") + 1 < SHORT else min_margin
                out[i] = (best[1] if margin >= least and best[1] in LANGUAGES else None, round(margin, 4))
        return out

    def settle(self, part: str, min_margin: float, min_words: int = MIN_WORDS) -> list[tuple[str, int, str | None, float]]:
        """A part of unclear language, cut once if two languages meet there.

        Two sentences without a mark between them make one part; it is cut before a capital
        letter, or before any word if it is all in one case, where both sides have ``min_words``
        words and are clearest, given that they differ. Long parts are tried at ``CUTS`` places
        evenly spread, then again around the clearest, so that the work grows with their length.
        """
        words = part.split()
        anywhere = part.islower() or part.isupper()
        cuts = [i for i in range(min_words, len(words) - min_words + 1) if anywhere or words[i][0].isupper()]
        best = None
        while cuts:
            step = -(-len(cuts) // CUTS)
            some = cuts[::step]
            sides = [" ".join(w) for i in some for w in (words[:i], words[i:])]
            got = self.classify(sides, min_margin)
            for n, i in enumerate(some):
                (a, x), (b, y) = got[2 * n], got[2 * n + 1]
                if a and b and a != b and min(x, y) >= CLEAR and (best is None or min(x, y) > best[0]):
                    best = (min(x, y), [(sides[2 * n], i, a, x), (sides[2 * n + 1], len(words) - i, b, y)])
            if step == 1:
                break
            # the clearest place, whether it is clear enough yet or not
            at = max(range(len(some)), key=lambda n: (got[2 * n][0] != got[2 * n + 1][0], min(got[2 * n][1], got[2 * n + 1][1])))
            cuts = cuts[max(0, (at - 1) * step + 1) : (at + 1) * step]
        if best:
            return best[1]
        lang, conf = self.classify([part], min_margin)[0]
        return [(part, len(words), lang, conf)]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """Prose of each language: seed plus labelled sentences of a bounded sample of rows.

    labelled: columns text and label. At most ``sample_rows`` rows reach the driver.
    """
    state = stated(F.col("label"))
    # of the lowest hashes, so many that the limit is met three times over on average
    part = min(1.0, 3 * sample_rows / max(1, labelled.count()))
    code = F.xxhash64("text")
    few = labelled.where((code >= -(2**63)) & (code <= int(-(2**63) + part * (2**64 - 2048))))
    rows = few.select("text", state.alias("lang")).where("lang is not null and length(text) > 60").orderBy(F.xxhash64("text"), "text").limit(sample_rows).collect()
    seed = Compressors(SEED)
    found: dict[str, dict[str, None]] = {k: {} for k in LANGUAGES}
    room = {k: DICTIONARY_BYTES - len(SEED[k].encode()) - 1 for k in LANGUAGES}
    for r in rows:
        if room[r["lang"]] <= 0:
            continue
        parts = [p for p, n in segments(r["text"]) if n >= MIN_WORDS]
        for p, (lang, _) in zip(parts, seed.classify(parts, MIN_MARGIN)):
            if lang == r["lang"] and p not in found[lang]:
                found[lang][p] = None
                room[lang] -= len(p.encode()) + 1
    return {k: "\n".join([*found[k], SEED[k]]) for k in LANGUAGES}


PART = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("words", T.IntegerType()), T.StructField("part", T.StringType())]))


def parts_udf(prose: dict[str, str], min_words: int = MIN_WORDS, min_margin: float = MIN_MARGIN, keep_text: bool = True):
    """A pandas UDF from a text to its classified segments."""

    @F.pandas_udf(PART)
    def parts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packed = Compressors(prose)
        for s in texts:
            cut = [[(p, n) for p, n in segments(t) if n >= min_words] if t else [] for t in s]
            flat = packed.classify([p for c in cut for p, _ in c], min_margin)
            out, at = [], 0
            for c in cut:
                row = []
                for (p, n), (lang, conf) in zip(c, flat[at : at + len(c)]):
                    two = conf < CLEAR and n >= 2 * min_words
                    for q, k, g, v in packed.settle(p, min_margin, min_words) if two else [(p, n, lang, conf)]:
                        row.append((g, v, k, q if keep_text else None))
                at += len(c)
                out.append(row)
            yield pd.Series(out)

    return parts


def languages(df: DataFrame, column: str, prose: dict[str, str], **options) -> DataFrame:
    """df with ``parts``: language, confidence, words and text of each segment."""
    return df.withColumn("parts", parts_udf(prose, **options)(F.col(f"`{column}`")))


def document_language(parts: Column) -> Column:
    """struct(lang, confidence) of a whole text: the language with most words, and its share of the words times its mean confidence."""
    known = F.filter(parts, lambda p: p["lang"].isNotNull())
    total = F.aggregate(parts, F.lit(0), lambda a, p: a + p["words"])

    def of(lang: str) -> Column:
        own = F.filter(known, lambda p: p["lang"] == lang)
        words = F.aggregate(own, F.lit(0), lambda a, p: a + p["words"])
        conf = F.try_divide(F.aggregate(own, F.lit(0.0), lambda a, p: a + p["confidence"]), F.size(own).cast("double"))
        return F.struct(words.alias("words"), F.lit(lang).alias("lang"), F.round(conf * F.try_divide(words.cast("double"), total.cast("double")), 4).alias("confidence"))

    best = F.array_max(F.array(*[of(k) for k in LANGUAGES]))
    return F.when(F.size(known) > 0, F.struct(best["lang"].alias("lang"), best["confidence"].alias("confidence")))
