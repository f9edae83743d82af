"""Sentence units across languages and scripts.

Method: a hidden-event n-gram language model.  A paragraph is a sequence of symbols
(class of the word before a gap, the mark in it with what closes after it, class of
the word after it, length of the stretch up to the next mark); a boundary event may
stand in every gap: after every mark, with a blank or without, and at every other
blank or line wrap.  Whether a gap lies inside quotation marks, brackets or a code
span that close in the same paragraph is part of its symbol, and so is a mark within
a name, path or number.  The n-gram counts, with Witten-Bell back-off, come from the
annotated sentences in ``SEEDS``; forward-backward over all gaps of a paragraph gives
the posterior of each event, and a posterior above one half ends a unit.  No gap is
ruled out before.

Structure is not left to the model: blank lines end a unit, and a heading or a list
item is one unit whatever stands in it.

Rows never leave their task: a scan and one Arrow map.

Defined results: null and blank texts have no units; a text without any mark is one
unit per paragraph; ``end_pos`` counts code points; repeated lines count once (the
reader keeps one row per line); texts of any length are processed whole.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

from provenlake.llm.tokenize import bounded

# Abbreviations by what follows them, chosen for this model.  TITLE comes before a name, NUMBER before a number,
# INNER inside a sentence; ENDING may also end one.
TITLE = frozenset("prof dr mr mrs ms hr hrn fr frau sr sra srta dra dna mme mlle m mm st sto pres gen col capt lt sgt rev hon ing lic dipl डॉ श्री г-н гр проф акад".split())
NUMBER = frozenset("no nr nos fig figs sec secs ch chap eq p pp l ll art vol núm num pág págs n° tab abb s bd kap ziff z§ рис стр гл табл apt".split())
INNER = frozenset("vs e.g i.e eg ie cf ca approx aprox env min max z.b d.h u.a z b d h u o.ä bzw bzgl ggf ggfs evtl inkl exkl sog usw.s vgl zzgl p.ej ej p.ex ex resp viz al incl excl est т.е т.к т.н т е напр им ок ул".split())
ENDING = frozenset("etc inc ltd co corp llc gmbh u.s u.k u.s.a a.m p.m usw u.s.w и.т.д т.д т.п д п ave blvd rd str jr bros dept".split())
MONTH = frozenset("januar februar märz april mai juni juli august september oktober november dezember january february march may june july october december uhr".split())
TOOLS = frozenset("git npm npx node pip pytest cargo docker make go curl bash sh python yarn pnpm kubectl helm mvn gradle tox eslint tsc ruff mypy rustc java javac ls cat sed awk".split())

END_MARKS = ".!?…。！？．।॥؟۔։።፧"
CLOSERS = "\"'”’»›」』】）)\\]*_`"
MARK = re.compile(rf"([{END_MARKS}]+)((?:[   ]?[»›])?[{CLOSERS}“]*)")
BLANK_SCRIPT = "\u0e00-\u0e7f\u0e80-\u0eff\u1780-\u17ff"
UNMARKED = re.compile(f"[{BLANK_SCRIPT}]")
CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d"
LAST_WORD = re.compile(r"[^\s\"“”„«»()\[\]{}`「」『』]+$")
NEXT_WORD = re.compile(r"[\w@#./\-']+")
LIST_ITEM = re.compile(r"\s*(?:[-*•‣◦+–]|\(?\d{1,3}[.)]|\(?[a-z]\))\s+\S")
HEADING = re.compile(r"\s{0,3}#{1,6}\s")
OPENERS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“”", "‹": "›", "【": "】"}
SHUT = {c for v in OPENERS.values() for c in v}

# Annotated sentences: a bar ends a unit.
SEEDS = """
The build is done.| We ship it now.| Tests are green!| Is it slow?| Yes.| It works.|
All 20 tests pass.| 14 of them are new.| The count is 31.| The rest follows.| It took 4.5 seconds, not 7.25.| Then it stopped.|
See Fig. 3 in sec. 4.2 for more.| Mr. Vale and Dr. Stone agree.| Prof. Lake, Inc. and Pond Ltd. are names.| The store of Pond Ltd. is shut.|
J. Stone and M. L. Vale wrote it.| Ask T. Rivers about p. 12 or l. 14.| No. 7 is next.| It needs min. 4 and max. 9 units.| We met vs. the odds, e.g. at night, i.e. late.|
The U.S. team left at 4 p.m. on Friday.| They met in the U.S.| The rest stayed.| It closed at 5 p.m.| The staff left.| Call at 6 a.m.| We wait.| It ends at 9 p.m.| git stops.| Paper, ink, etc. are here.| We buy paper, ink, etc.| Then we go.| It has a tax no. X12 here.| The person no. QZ 05 is old.| He has no.| Then he left.| It is no. 4 of 9.|
Rows 3.–5. of the list are old.| He said "Go now." and left.| She asked "Why?" and waited.| They cried "Stop!" again.| I left a note: "Do not stop!"| The rest is easy.|
It says "try again."| Then it ends.| It says "try again!"| git works now.| I read "it is over."| pytest finds more.| We wrote "see below."| main.py is new.| It means "no!"| npm waits.|
Wait (it is late. Really.) for it.| It stopped (again!) at noon.| It is late (see below).| We go.| It ran (twice.)| Then it left.| It ran (three times, at most).| npm is next.|
Well... we will see.| It waits... and then it runs.| It hangs…| We wait.| And then… nothing came.| It just stops...| Nothing more.| So it hangs…| git waits.|
We are done.| git shows less.| The tree is clean.| npm still waits.| It is old.| main.py is new.| The file is gone.| outbox.sh moved.| We go on.| node prints more.|
Why did it exit?!| Nobody knows.| Really?!| Yes!| Is it?| no.| The run ended.|We go on.| The line is long.|Next one is short.| Is it right?|Yes it is.| It took 4.25 ms.|Then it ended.|
The value is 42.|Then it grew.| Run it with -q.| Then wait.| Type EXIT=$?.| It helps.| It ended with 'done'.| More follows.| The name is `x.y`.| Fine.|
Das ist gut.| Wir gehen am 9. März um 4.30 Uhr.| Es gibt z. B. zwei, d. h. wenige.| Hr. Stein und Fr. Bach kommen.| Laut Hrn. Stein ist es gut.| Es sind ca. 30, u. a. die alten.| Am 3. Mai war es kalt.| Es kostet 12.| Das ist viel.|
Bzgl. der Liste ist ggf. mehr nötig.| Die Meldung „Weg. Ende!“ kommt oft.| Er sagt „Nein.“| Dann geht er.| Soll ich gehen?| Ja!|
C'est fini.| M. Roche arrive, cf. la page p. 5.| Faut-il partir ?| Oui !| Le mot « Fin. Rien. » est clair.| C'est env. dix, p. ex. ici.| Il dit « Non. »| Puis il part.|
Es tarde.| El Sr. Vega y la Sra. Luna llegan.| ¿Vamos ya?| ¡Sí!| Hay aprox. diez, p. ej. los viejos.| Es el núm. 9 de la lista.| El aviso «Falta. Fin.» sale aquí.| Eso es todo.| ¿Seguro?|
Это хорошо.| Идём, т. е. едем, и т. д. до утра.| Он сказал «Нет. Да.» и ушёл.| Почему?| Да!| Осталось пять.| Мы ждём.| См. рис. 4 и стр. 7.| Всё.|Идём дальше.| Das ist gut.|Wir gehen.| Fertig!|Los.| It is 5 ms.|Is it?|No one knows.|
这很好。|我们走。|为什么？|好！|他说“不行。走吧。”然后走了。|版本是4.5。|还有“等等！”这句。|
これは良い。|行きますか？|はい！|彼は「だめ。行け。」と言った。|値は4.5です。|「待て！」と叫んだ。|もう終わりました。|「終わり。」|次へ。|
이것은 좋습니다.| 갑니다.| 왜?| 네!| 그는 "안 돼. 가."라고 했습니다.| 값은 4.5입니다.| 끝났습니다.| main.py 파일입니다.|
यह अच्छा है।| डॉ. राव आए।| क्या हम चलें?| हाँ!| कुल 5.5 लगे।| बस।|
هذا جيد.| هل نذهب؟| نعم!| القيمة 4.5 فقط.| انتهى العمل.| قال "لا." ثم ذهب.|
นี่คือดี| ไปกันเถอะ| ทำไม| มาก| ดีแล้ว| เสร็จ|
Run ./start.sh --now or src/lake/main.go first.| "./start.sh -q" gave 0.| I ran `./start.sh --all`; it is old.| Copy ../a_b/c.txt and ~/.lake/conf.d to it.| Open https://lake.example/a.html?x=1 now.| Mail a.stone@mail.example or to b_c.d@mail.example.| Take v1.2.3 or v4.5.Final.| The class is lake.Store.Item here.| J.Stone and M.Vale left.| Call open_file.Read or a.B next.| It is in main.py.|Then it ends.| It is in /lake/a.Store and x_y.Item.|
It is late.|Done!| We wait.|No. 4 is next.| They go!|Prof. Lake left.| It grew.|Rows 5 and 6 are last.| Use lake.Open(a) and fmt.Put("b").| Is it so?|Oui.| It ended.|Faut-il partir ?| So it is.|Wait, who left?|
It is late.| **Then** it ends.| It is old.| <b>We</b> go on.| So it grew.| > The rest is easy.| We ran go test ./lake/... and go vet ./pond/... 4 times.| Run go build ./lake/... Paper or go vet ./... `b` here.| Then run go test ./lake/....| 3 failed.| We run go vet ./pond/....| Then it ends.| Is it so?| @stone knows.| We wait!| *No* more is left.|
He said "It is late. We go! Is it? No. git waits. 5 are left. (One is old.) And so on… Then it ends." and left.| The list (a stone. Two lakes! No? 3 of them. main.py is old. “So it is.” And then... more.) is long.| It is `a b. C d` or [see it. Then go! Why? 4.5 is it.] here.| 他说“好。真的吗？不行！走。”然后走了。| 그는 "왜? 네! 가."라고 했습니다.|
ซื้อ 5 ชิ้น| ใช้ main.py แล้ว| ไป npm ดี| เขาพูด "ไป กัน เถอะ" แล้ว| นี่ (ดี มาก แล้ว) เสร็จ| มี 20 วัน|
ค่า x2 ดี| แบบ B มาก| ที่ Inc นี้| ราคา vs นี้| คุณ Dr มา| ข้อ No นี้| คำ 好 ดี| ดู (git) ดี| ราคา $4 - นี้| ไฟล์ ./lake/ ดี|
用 git 命令 看 日志，再 看 5 个 文件 和 main.py 的 内容。|方案 B 好，No 好，x2 也 好，etc 不 好，vs 不 行，Dr 来 了，Inc 也 来，(新) 文件 在 <这里> 吧。| これ は git の 値 です。|네 好 吧。| В 好 的。|
Use e.g. `ls` or i.e. **All**, cf. <b>B</b> and vs. $4.| Ask Dr. **Stone** and J. *Vale* for no. #4, etc. `a` and so on at 4 p.m. *now*.| See fig. **3** or p. `4`, U.S. $5 in all.|
It is late.| March begins.| Is it so?| May is warm.| It ended!| Juli ist da.| Am 4. Juni und am 5. Mai war es kalt.| Is it so?| 4 are left.| Go now!| 12 went.| They wait...| 9 of them left.| So it is…| 7 are new.|
It ended.| (It was old.)| Is it so?| (It is.)| We go!| [All of it.]| It grew...| (It did.)| Are they new?| ดีแล้ว| Go!| มาก| They left.| ดี|
走了。|5个文件。|git 好。|main.py 行！|12次？|4次。|Dr 来。|（新）文件。|March 好。|`a` 行。| 5 है।| 4 लगे।| (बस)।| git है।|
""".strip()


def word_class(w: str, before_code: bool = True) -> str:
    """Class of the word before a mark; a lower-case "no" abbreviates only before something with digits."""
    bare = w.strip("([{\"'“„«*_`").rstrip(".")
    low = bare.casefold()
    if not bare:
        return "none"
    if len(bare) == 1 and bare.isupper():
        return "initial"
    if low in ENDING:
        return "ENDING"
    if low in INNER:
        return "INNER"
    if low in TITLE and (len(low) > 1 or bare[0].isupper()):
        return "TITLE"
    if low in NUMBER and (bare != "no" or before_code):
        return "NUMBER"
    if bare.replace(".", "").replace(",", "").isdigit():
        return "digits"
    if "." in bare and all(len(x) == 1 for x in low.split(".")):
        return "INNER"
    begun = bare.rpartition(".")[2]
    if len(begun) > 1 and begun[0].isupper() and begun != bare:  # a sentence may begin without a blank: late.No. 4
        return word_class(begun, before_code)
    c = bare[-1]
    if c == "/":
        return "path"
    if c.isdigit():
        return "code"
    if UNMARKED.match(c):
        return "unmarked"
    return "cjk" if re.match(f"[{CJK}]", c) else "word"


def next_class(p: str, i: int) -> str:
    """Class of what stands after a mark, from position i on."""
    if i >= len(p):
        return "end"
    c = p[i]
    if c in "\"“„«‹「『":
        return "quote"
    if c in "([（【":
        return "bracket"
    if c in "¿¡":
        return "upper"
    if re.match(f"[{CJK}]", c):
        return "cjk"
    if UNMARKED.match(c):
        return "unmarked"
    m = NEXT_WORD.match(p, i)
    if not m:
        return "sign"
    w = m[0].rstrip(".'-")
    low = w.casefold()
    if c.isdigit():
        return "digits"
    if low in TOOLS or ("." in w and "/" not in w) or "_" in w or "/" in w:
        return "tool"
    if low in MONTH and c.isupper():
        return "month"
    if c.isupper():
        return "upper"
    return "lower" if c.islower() else "caseless"


def spans(p: str) -> list[tuple[int, int]]:
    """Stretches between opening and closing quotation marks, brackets and backticks of one paragraph."""
    out, stack, plain, tick = [], [], -1, -1
    for i, c in enumerate(p):
        if c == '"':
            if plain < 0:
                if i + 1 < len(p) and not p[i + 1].isspace():
                    plain = i
            elif i and not p[i - 1].isspace():
                out.append((plain, i))
                plain = -1
        elif c == "`":
            if tick < 0:
                tick = i
            else:
                out.append((tick, i))
                tick = -1
        elif c in OPENERS and not (c == "“" and stack and "“" in stack[-1][1]):
            stack.append((i, OPENERS[c]))
        elif c in SHUT:
            for k in range(len(stack) - 1, -1, -1):
                if c in stack[k][1]:
                    out.append((stack[k][0], i))
                    del stack[k:]
                    break
    return out


QUICK_SPAN = re.compile("[\"`(\\[（「『«“„‹【]")
CHUNK = re.compile(r"\S+")
WIDE = "。！？।॥؟۔։።፧．"


@lru_cache(1 << 16)
def _blank_left(tail: str) -> str:
    w = LAST_WORD.search(tail)
    return word_class(w[0]) if w else "none"


@lru_cache(1 << 16)
def _blank_right(chunk: str) -> str:
    return next_class(chunk, 0)


def tight_left(w: str, marks: str) -> str:
    """Class of the word before a mark that the next word follows without a blank."""
    if "@" in w or "/" in w or "_" in w:
        return "path"
    if marks == "." and len(w) < 2 and not w.isdigit():
        return "letter"
    if marks == "." and "." in w and not re.fullmatch(r"[\d.,]+", w):
        return "file" if re.fullmatch(r"[a-z]\w+\.[a-z]{1,5}", w) else "dotted"
    return word_class(w) if w else "none"


def tight_right(p: str, k: int) -> str:
    """Class of what follows a mark without a blank.

    A phrase is a capitalised word and one more, a name any other such word, a member one that code goes on from.
    """
    if "\uac00" <= p[k] <= "\ud7af":
        return "hangul"
    m = NEXT_WORD.match(p, k)
    v = m[0] if m else ""
    if "@" in v:
        return "path"
    if p[k] in "¿¡":
        return "phrase"
    if p[k].isupper() and (len(v) == 1 or v[1:2].islower() or not v.isascii()):
        if v[1:2].islower() and re.match(r"[^\W\d_]{2,} [^\W\d_]", p[k : k + 40]):
            return "phrase"
        return "member" if "." in v.rstrip(".'-") or p[k + len(v) : k + len(v) + 1] in tuple("([{=") else "name"
    return "capital" if p[k].isupper() else next_class(p, k)


def candidates(p: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(end, next, left, mark, right) of every gap of a paragraph: after every mark and at every other blank.

    Nothing is decided here.  What a gap stands in or next to (a closed span, a mark without a blank) is part of
    its symbols, and the model weighs an event at each.
    """
    closed = sorted(spans(p)) if QUICK_SPAN.search(p) else []
    starts, shuts = [a for a, _ in closed], {b for _, b in closed}
    furthest = list(accumulate((b for _, b in closed), max))  # of all spans that start no later

    def inside(s: int, e: int) -> bool:
        """Whether a span starts before s and ends at e or later."""
        k = bisect_left(starts, s)
        return k > 0 and furthest[k - 1] >= e

    n = len(p)
    first, last = 0, -1  # of the word before the blank
    found, ends = MARK.finditer(p), ()  # where the blank after a word belongs to the latest mark
    m = next(found, None)
    for c in chain(CHUNK.finditer(p), (None,)):
        while m and (c is None or m.start() < last):
            s, e = m.start(), m.end()
            marks, shut = m[1], m[2]
            k = e
            while k < n and p[k].isspace():
                k += 1
            gap = k > e
            ends = e, m.end(1)
            # closers after the mark must really close something: an opening quote is not part of the unit
            if shut and not gap and e < n and shut[-1] in "\"*_`'“" and (p[e].isalnum()) and e - 1 not in shuts:
                cut = len(shut.rstrip("\"*_`'“"))
                e = m.start(2) + cut
                shut = shut[:cut]
                k = e
            wide = any(c in WIDE for c in marks)
            kind = "stop" if wide and not any(c in "！？؟" for c in marks) else "call" if any(c in "!?！？؟" for c in marks) else "dots" if marks.startswith("…") or "..." in marks else "dot"
            if shut.strip():
                kind += " quote" if any(c in "\"”’»›」』】“" for c in shut) else " bracket" if any(c in ")）]】" for c in shut) else ""
            left = LAST_WORD.search(p, max(0, s - 40), s)
            if kind == "dots" and marks == "...." and left and left[0].endswith("/"):  # ./lake/... and a full stop
                kind = "dot"
            if not gap and k < n and not wide:
                kind += " tight" if not shut or shut[-1] not in "*_`" else " closer tight"
                before, after = tight_left(left[0] if left else "", marks), tight_right(p, k)
            else:
                before, after = word_class(left[0], any(c.isdigit() for c in p[k : k + 6])) if left else "none", next_class(p, k)
            yield e, k, before, kind + " in" if closed and inside(s, e) else kind, after
            m = next(found, None)
        if c is None:
            return
        s, e = c.span()
        if last > 0 and last not in ends:
            right = _blank_right(c[0]) if e - s < 64 else next_class(p, s)
            yield last, s, _blank_left(p[max(0, last - 40, first) : last]), "blank in" if closed and inside(last, s) else "blank", right
        first, last = s, e


class HiddenEvents:
    """Counts of (left, mark, event), (mark, event, right) and of stretch lengths between marks after an event."""

    def __init__(self, seeds: str):
        self.event: dict = defaultdict(Counter)
        self.right: dict = defaultdict(Counter)
        self.length: dict = defaultdict(Counter)
        self.rights: set[str] = set()
        for line in seeds.split("\n"):
            text, ends = "", set()
            for part in line.split("|"):
                text += part
                ends.add(len(text.rstrip()))
            before, at = True, 0
            for e, k, left, mark, right in candidates(text):
                b = e in ends
                place = self.place(mark)
                for ctx in ((left, mark), (mark,), place, ()):
                    self.event[ctx][b] += 1
                for ctx in ((left, mark, b), (mark, b), (place, b), (b,)):
                    self.right[ctx][right] += 1
                self.rights.add(right)
                if mark.startswith("blank"):
                    before = before or b
                    continue
                self.length[before][self.size(text, at, e)] += 1
                before, at = b, k

    @staticmethod
    def place(mark: str) -> tuple:
        """What all marks share that stand like this one: at a mere blank, without a blank, inside a closed span."""
        return ("place", mark.startswith("blank"), " tight" in mark, mark.endswith(" in"))

    @staticmethod
    def size(p: str, a: int, e: int) -> int:
        n = p.count(" ", a, e)
        return 0 if n == 0 else 1 if n < 3 else 2

    @staticmethod
    def _backoff(table: dict, contexts: tuple, x, last: float) -> float:
        p = last
        for ctx in reversed(contexts):
            c = table.get(ctx)
            if c:
                n, t = sum(c.values()), len(c)
                p = (c.get(x, 0) + t * p) / (n + t)
        return p

    def steps(self, left: str, mark: str, right: str) -> list[tuple]:
        """Joint weight of (no event, event) with what stands after the gap; at a mark, by length of the stretch before
        it, with the weight of that length after (no event, event)."""
        out, place = [], self.place(mark)
        for b in (False, True):
            pe = self._backoff(self.event, ((left, mark), (mark,), place, ()), b, 0.5)
            pr = self._backoff(self.right, ((left, mark, b), (mark, b), (place, b), (b,)), right, 1.0 / (len(self.rights) + 1))
            out.append(pe * pr)
        if mark.startswith("blank"):
            return [(*out, None)]
        return [(*out, tuple(self._backoff(self.length, (b,), size, 1 / 3) for b in (False, True))) for size in range(3)]

    def posteriors(self, p: str, cands: Iterator[tuple[int, int, str, str, str]], memo: dict) -> Iterator[tuple[int, float]]:
        """(end, probability of a boundary) of each gap, last one first, by forward-backward.

        The state tells whether the stretch since the last mark begins a unit: a mark sets it, an event at a mere
        blank turns it on.
        """
        ends, steps, fwd, at = array("q"), [], array("d"), 0
        f, g = 0.0, 1.0
        for e, k, left, mark, right in cands:
            key = (left, mark, right)
            w = memo.get(key)
            if w is None:
                memo[key] = w = self.steps(left, mark, right)
            if len(w) == 1:
                step = w[0]
                no, yes, _ = step
                h = (f + g) * yes
                f, g = f * no, g * no + h
            else:
                step = w[self.size(p, at, e)]
                no, yes, (x, y) = step
                at = k
                total = f * x + g * y
                f, g = total * no, total * yes
                h = g
            z = f + g
            f, g = f / z, g / z
            ends.append(e)
            steps.append(step)
            fwd.extend((f, g, h / z))
        b, c = 1.0, 1.0
        for i in range(len(steps) - 1, -1, -1):
            f, g, h = fwd[3 * i : 3 * i + 3]
            yield ends[i], h * c / (f * b + g * c)
            no, yes, link = steps[i]
            if link is None:
                b, c = no * b + yes * c, (no + yes) * c
            else:
                ahead = no * b + yes * c
                b, c = link[0] * ahead, link[1] * ahead
            z = b + c
            b, c = b / z, c / z


_model: HiddenEvents | None = None
_memo: dict = {}


def model() -> HiddenEvents:
    global _model
    if _model is None:
        _model = HiddenEvents(SEEDS)
    return _model


def blocks_of(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): paragraphs, and headings and list items, which are whole units."""
    at, n = 0, len(text)
    start, whole = -1, False
    while at <= n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        line = text[at:stop]
        if not line.strip():
            if start >= 0:
                yield start, at, whole
            start, whole = -1, False
        elif HEADING.match(line):
            if start >= 0:
                yield start, at, whole
            yield at, stop, True
            start, whole = -1, False
        elif LIST_ITEM.match(line) and not (start >= 0 and not whole and _wraps(text, at, line)):
            if start >= 0:
                yield start, at, whole
            start, whole = at, True
        elif start < 0:
            start = at
        elif whole and not (line[:1].isspace() or line.lstrip()[:1].islower()):
            yield start, at, whole
            start, whole = at, False
        at = stop + 1
    if start >= 0:
        yield start, n, whole


def _wraps(text: str, at: int, line: str) -> bool:
    """A dash, a plus or a lone letter at the start of a line can be part of a wrapped sentence."""
    first = line.lstrip()
    before = text[:at].rstrip()[-1:]
    return (first[:1] in "–+" or bool(re.match(r"[a-z]\)\s", first))) and before.isalnum()


def unit_ends(text: str | None) -> list[int]:
    """End positions of all sentence units of a text."""
    if not text or text.isspace():
        return []
    out, m = [], model()
    for a, b, whole in blocks_of(text):
        p = text[a:b]
        lead = len(p) - len(p.lstrip())
        last = len(p.rstrip())
        if last <= lead:
            continue
        if not whole:
            p = p[:last]
            cands = (c for c in candidates(p) if c[0] < last)
            for e in reversed([e for e, q in m.posteriors(p, cands, _memo) if q > 0.5]):
                out.append(a + e)
        out.append(a + last)
    return out


def sentence_units(texts: DataFrame) -> DataFrame:
    """(session, seq, block, end_pos) for every unit; ``texts`` has session, seq, block, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bounded(whole, 3):
                ends = [unit_ends(t) for t in b.column(3).to_pylist()]
                pick = pa.array([i for i, e in enumerate(ends) for _ in e], pa.int64())
                keys = [b.column(k).take(pick) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([x for e in ends for x in e], pa.int64())], names=["session", "seq", "block", "end_pos"])

    return texts.select("session", "seq", "block", "text").mapInArrow(run, "session string, seq long, block long, end_pos long")
