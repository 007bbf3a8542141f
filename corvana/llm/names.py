"""Problem 6: variant spellings of names, by a prefix-filtered set-similarity join and soft weighted token similarity.

A name is read into pieces: its main form, and what stands in brackets, in quotation marks or after "tức". The words of all
names are counted, and for each distinct word the table itself says, by joins, what it may stand for:

* spellings of one word that differ in the place of the tone, or are typed with input-method keys, are the most frequent one;
* a word is a slip of another if one edit turns it into one that is at least `ratio` times as frequent. The words one edit
  away are found by a deletion index (two such words agree once at most one letter is left out of each);
* a run is divided into the fewest words of the table that are each at least `ratio` times as frequent;
* an abbreviation is written out from the table of short forms.

Being ratios, these tests act alike at every size of the table, and only the words of a name travel with it.

Tokens then take roles: words of kind (titles, kinds of company or place), markers (numbers, models, years, branches; they
must agree), and the core. Candidates: the q-grams and tokens of a form's core, as a set (around the end for persons, so that
reordered parts keep theirs), ordered by rarity; a pair must share `least` of the larger set, so one of the rarest grams
(the prefix) of each side must be a rarest gram of the other. The join is an equi-join of the two prefixes within one type
and one key: whatever `link` accepts has one of its `keys` in common, so no pair is lost by them, and a form whose keys no
other name has is left out before the join. Common syllables alone therefore make no candidates.

Verification: tokens are aligned in order (persons: in any rotation) and compared softly - equal, equal without marks, a
slip, or an initial - and weighted by rarity. Kinds agree if their words, their initials or abbreviations agree, or if the
two phrases of kind name the same cores and markers again and again (not for places, whose ranks differ by rule). Pairs are
strong (all of the core agrees) or weak (initials, a missing middle part, kind words missing, another name given only
there); a weak pair counts only if the short side's links lead to one single entity. The entities are the connected
components.

Defined results: null, blank or wordless names and null types link to nothing; rows of one id count once (the smallest
name); equal names of one type are linked; types outside the two vocabularies are types of their own; null short forms are
ignored; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import combinations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.functions.arrow import map_batches
from corvana.llm.components import components
from corvana.session import stored

#: The two vocabularies of types (fixed values).
TYPES = {
    "cá nhân": "PERSON", "tổ chức": "ORG", "địa điểm": "LOC", "đội thể thao": "SPORT_TEAM",
    "cơ sở vật chất": "FACILITY", "sản phẩm": "PRODUCT", "sự kiện": "EVENT",
}
#: Titles before a person's name (fixed values of the language).
TITLES = frozenset(
    "ông bà anh chị cô chú bác cụ thầy em gs pgs ts ths bs ks ls cn nsnd nsưt đd "
    "giáo_sư phó_giáo_sư tiến_sĩ thạc_sĩ bác_sĩ luật_sư kỹ_sư cử_nhân nghệ_sĩ nghệ_sĩ_ưu_tú nghệ_sĩ_nhân_dân nhà_giáo nhà_báo nhà_văn nhà_thơ ca_sĩ nhạc_sĩ diễn_viên đạo_diễn "
    "huấn_luyện_viên vận_động_viên đại_tá thượng_tá trung_tá thiếu_tá đại_úy thượng_úy trung_úy thiếu_úy đại_tướng thượng_tướng trung_tướng thiếu_tướng chuẩn_đô_đốc "
    "chủ_tịch phó_chủ_tịch giám_đốc tổng_giám_đốc bộ_trưởng thứ_trưởng bí_thư đại_biểu".split()
)
#: Words of kind in names of organisations, places and things (fixed values of the language).
KINDS = frozenset(
    "công ty cổ phần trách nhiệm hữu hạn tập đoàn tổng doanh nghiệp tư nhân ngân hàng thương mại bệnh viện đa khoa phòng khám trường đại học cao đẳng trung phổ thông tiểu mầm non tâm nghiên cứu "
    "hợp tác xã ủy ban dân câu lạc bộ bóng đá chuyền rổ điền kinh bơi lội đội tuyển liên hiệp hội quỹ sở cục hãng tin đồng dược phẩm nông sản thủy dệt may xây dựng vận tải cơ khí bao bì in ấn chế biến gỗ "
    "năng lượng du lịch địa chất tế công nghệ bảo hiểm chứng khoán bất động huyện phường thị trấn quận thành phố tỉnh thôn ấp làng cù lao sông núi hồ đảo đường cầu cảng sân bay quốc nhà máy văn hóa hát vượt viên phần mềm "
    "tàng thư chợ khu giải lễ hoan phim cúp festival điện thoại xe sữa hạt ứng dụng tính app fc".split()
)
MODELS = frozenset("mini pro plus max lite ultra air se".split())
BRANCH = ("chi nhanh", "co so", "phan hieu")
_ALSO = re.compile(r"\s(?:tức là|tức|hay còn gọi là|còn gọi là|biệt danh|bí danh|alias|aka)\s")
_BRACKET = re.compile(r"[(\[]([^)\]]*)[)\]]")
_QUOTED = re.compile("[\"“”«»]([^\"“”«»]+)[\"“”«»]")
_SPLIT = re.compile(r"[\s\-‐–—/·’'`]+")
_VOWEL = re.compile("[aeiouy]")
_TONES = "̣̀́̃̉"
_KEYS = {"f": _TONES[0], "s": _TONES[1], "x": _TONES[2], "r": _TONES[3], "j": _TONES[4]}


def fold(s: str) -> str:
    """Without marks; đ as d."""
    if s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("đ", "d")


def toned(s: str) -> str:
    """The letters without tones, then the tones: one form wherever in the word the tone is put."""
    if s.isascii():
        return s
    d = unicodedata.normalize("NFD", s)
    tones = "".join(sorted({c for c in d if c in _TONES}))
    return unicodedata.normalize("NFC", "".join(c for c in d if c not in _TONES)) + tones


def keyed(s: str) -> str | None:
    """What a word typed with input-method keys (aa, ow, dd, final s f r x j) stands for, as `toned`; None if it has none."""
    if not (s.isascii() and s.isalpha()) or s in MODELS or not _VOWEL.search(s):
        return None
    t = s.replace("dd", "đ").replace("aa", "â").replace("ee", "ê").replace("oo", "ô").replace("uwo", "uow").replace("uoww", "uow")
    t = t.replace("uow", "ươ").replace("aw", "ă").replace("ow", "ơ").replace("uw", "ư")
    at = max((i for i, c in enumerate(t) if c in _KEYS and i and _VOWEL.search(fold(t[:i]))), default=-1)
    if at > 0:
        t = t[:at] + t[at + 1 :] + _KEYS[t[at]]
    return t if t != s else None


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, exchange of letters or swap of neighbours turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def fewest_parts(length: int, spans: list[tuple[int, int, str]]) -> list[str] | None:
    """The fewest spans (begin, end, word) that cover 0..length end to end; None if there are none. Ties: the longest first."""
    best: list = [[]] + [None] * length
    for b, e, w in sorted(spans, key=lambda s: (s[1], s[0])):
        if best[b] is not None and (best[e] is None or len(best[b]) + 1 < len(best[e])):
            best[e] = [*best[b], w]
    return best[length] if best[length] and len(best[length]) > 1 else None


# ---- reading


def pieces(name: str | None, cls: str) -> list[tuple[str, list[str]]]:
    """(how, raw tokens) of the main form ('main'), of brackets ('in') and of other names ('also')."""
    if not name or not name.strip():
        return []
    s = " ".join(unicodedata.normalize("NFC", name).lower().split())
    extra = [("in", x) for x in _BRACKET.findall(s)]
    s = _BRACKET.sub(" ", s)
    if cls == "PERSON":
        extra += [("also", x) for x in _QUOTED.findall(s)]
        s = _QUOTED.sub(" ", s) if _QUOTED.sub(" ", s).strip() else s
    s = re.sub('["“”«»]', " ", s)
    main, *also = _ALSO.split(f" {s} ")
    extra += [("also", x) for x in also]
    if "," in main and cls == "PERSON":
        b, _, a = main.partition(",")
        main = f"{a} {b}"
    got = [(how, raw_tokens(x, cls)) for how, x in [("main", main), *extra]]
    return [g for g in got if g[1]] if got[0][1] else []


def raw_tokens(text: str, cls: str) -> list[str]:
    """Words between white space and signs; a word with dots is one title, initials (each with its dot), or several words."""
    out: list[str] = []
    for t in _SPLIT.split(text.replace("_", " ")):
        t = t.strip(",;:")
        bare = t.replace(".", "")
        if not bare:
            continue
        if "." not in t:
            out.append(t)
        elif cls == "PERSON" and bare in TITLES:
            out.append(bare)
        elif all(len(x) == 1 for x in t.split(".") if x):
            out += [x + "." for x in bare] if cls == "PERSON" else [bare + "."]
        else:
            out += re.findall(r"[^.]+\.?", t)
    return out


# ---- words of the table


def _words(tokens: DataFrame, total: int, short_forms: DataFrame, ratio: int) -> DataFrame:
    """(cls, w, says): for every distinct word of a type, what it may stand for (see the module's text), as a struct."""
    w = tokens.groupBy("w").agg(F.count(F.lit(1)).alias("n"))

    def forms_(_, cols):
        bare = [x.rstrip(".") for x in cols["w"]]
        return {"w": cols["w"], "n": cols["n"], "t": [toned(x) for x in bare], "f": [fold(x) for x in bare], "k": [keyed(x) for x in bare], "word": [x.isalpha() and len(x) > 1 for x in bare]}

    w = stored(map_batches(w, forms_, "w string, n long, t string, f string, k string, word boolean"), "words")
    real = w.where("word")
    spelled = real.groupBy("t").agg(F.max_by("w", F.struct("n", "w")).alias("c"), F.sum("n").alias("n"))
    best = real.select("w", "n", F.col("t").alias("u")).unionByName(real.where("k is not null").select("w", "n", F.col("k").alias("u")))
    best = best.join(spelled.select(F.col("t").alias("u"), "c", F.col("n").alias("nc")), "u").where("c = w or nc >= n").groupBy("w").agg(F.max_by("c", F.struct("nc", "c")).alias("c"))
    folds = real.groupBy("f").agg(F.sum("n").alias("nf"), F.max_by("w", F.struct("n", "w")).alias("c"))

    def holes(_, cols):
        out = {"w": [], "n": [], "x": [], "key": [], "side": []}
        for word, n, t, f, bare_word in zip(cols["w"], cols["n"], cols["t"], cols["f"], cols["unlike"]):
            left = "lr" if bare_word else "r"
            for space, x, sides in (("f", f, left if word.isascii() else "r"), ("t", t, "" if word.isascii() else "lr"), ("w", word.rstrip("."), "" if word.isascii() else "lr")):
                for key in {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))} if sides and len(x) > 2 else ():
                    out["w"].append(word), out["n"].append(n), out["x"].append(x), out["key"].append(space + key), out["side"].append(sides)
        return out if out["w"] else None

    # a word without marks whose marked forms are known is no slip
    h = stored(map_batches(real.join(folds.select("f", "nf"), "f").withColumn("unlike", F.expr("nf < 2 * n")), holes, "w string, n long, x string, key string, side string"), "holes")
    slip = h.where("side = 'lr'").alias("a").join(h.alias("b"), F.expr(f"a.key = b.key and b.n >= {ratio} * a.n and a.x <> b.x")).select(F.col("a.w").alias("w"), F.col("a.x").alias("x"), F.col("b.w").alias("v"), F.col("b.x").alias("y"), F.col("b.n").alias("n")).distinct()

    def slips(_, cols):
        keep = [i for i, (x, y) in enumerate(zip(cols["x"], cols["y"])) if near(x, y)]
        return {"w": [cols["w"][i] for i in keep], "v": [cols["v"][i] for i in keep], "n": [cols["n"][i] for i in keep]}

    slip = map_batches(slip, slips, "w string, v string, n long").groupBy("w").agg(F.sort_array(F.collect_set(F.struct("n", "v")), asc=False)["v"].alias("near"))

    def spans(_, cols):
        out = {"w": [], "n": [], "b": [], "e": [], "v": []}
        for word, n, f in zip(cols["w"], cols["n"], cols["f"]):
            for b in range(len(word)):
                for e in range(b + 2, min(b + 8, len(word)) + 1):
                    if e - b < len(word):
                        out["w"].append(word), out["n"].append(n), out["b"].append(b), out["e"].append(e), out["v"].append(word[b:e])
        return out if out["w"] else None

    s = map_batches(real.where("char_length(f) >= 5 and char_length(f) = char_length(w)"), spans, "w string, n long, b int, e int, v string")
    whole = real.select(F.col("w").alias("v"), F.col("n").alias("m"), F.col("w").alias("c")).unionByName(folds.where("f <> c").select(F.col("f").alias("v"), F.col("nf").alias("m"), "c")).groupBy("v").agg(F.max(F.struct("m", "c")).alias("x")).select("v", "x.*")
    s = s.join(whole, "v").where(F.col("m") >= ratio * F.col("n")).groupBy("w").agg(F.collect_list(F.struct("b", "e", F.concat_ws(" ", "v", "c").alias("v"))).alias("spans"))

    def parts(_, cols):
        got = [fewest_parts(len(x), [(p["b"], p["e"], p["v"]) for p in ps]) for x, ps in zip(cols["w"], cols["spans"])]
        return {"w": cols["w"], "parts": got}

    s = map_batches(s, parts, "w string, parts array<string>").where("parts is not null")
    full = short_forms.where("short_form is not null and full_form is not null").select(F.lower(F.trim("short_form")).alias("s"), F.split(F.lower(F.trim("full_form")), r"\s+").alias("full"))
    full = full.withColumn("w", F.explode(F.array_distinct(F.array("s", F.concat(F.rtrim("s", F.lit(".")), F.lit(".")), F.rtrim("s", F.lit(".")))))).groupBy("w").agg(F.min("full").alias("full"))
    rarity = F.log(1 + F.lit(float(total)) / (1 + F.coalesce("nf", F.lit(0))))
    says = w.join(best, "w", "left").join(slip, "w", "left").join(s, "w", "left").join(full, "w", "left").join(folds.select("f", "nf"), "f", "left")
    says = says.select("w", "f", F.struct(F.coalesce("c", "w").alias("c"), "near", "parts", "full", rarity.alias("weight")).alias("says"))
    like = tokens.groupBy("cls", "w").agg(F.count(F.lit(1)).alias("n")).join(real.select("w", "f"), "w").groupBy("cls", "f").agg(F.max_by("w", F.struct("n", "w")).alias("like"))
    # words of kind of a type: nearly always first, or nearly always followed by one word
    by = tokens.groupBy("cls", "w", "after").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("first"))
    by = by.groupBy("cls", "w").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.max(F.when(F.col("after") != "", F.col("n"))).alias("top"))
    size = by.groupBy("cls").agg(F.sum("first").alias("size"))
    kind = by.join(F.broadcast(size), "cls").where("cls <> 'PERSON'")  # one row for each type
    kind = kind.select("cls", "w", F.expr("n >= greatest(12, 0.02 * size) and (first >= 0.85 * n or coalesce(top, 0) >= 0.85 * n)").alias("kind"))
    return stored(tokens.select("cls", "w").distinct().join(says, "w").join(kind, ["cls", "w"], "left").join(like, ["cls", "f"], "left").select("cls", "w", F.struct("says.*", F.coalesce("like", "w").alias("like"), F.coalesce("kind", F.lit(False)).alias("kind")).alias("says")), "says")


def spelled(tokens: list[dict], cls: str) -> list[dict]:
    """Tokens as dicts w (word), like (the likeliest word with its letters), v (what it is a slip of), g (weight), kind;
    written out, corrected and divided."""
    token = lambda w, like=None, v=(), g=1.0, kind=False: {"w": w, "like": like or w, "v": v, "g": g, "kind": kind}
    out = []
    for t in tokens:
        w, bare = t["w"], t["w"].rstrip(".")
        if cls == "PERSON" and w.endswith(".") and len(bare) == 1:
            out.append(token(w, g=0.1))
        elif t["full"] and (cls != "PERSON" or len(bare) > 1):
            out += [token(x) for x in t["full"]]
        elif bare in TITLES or bare in KINDS or not bare.isalpha():
            out.append(token(bare, g=t["weight"], kind=t["kind"]))
        elif t["parts"] and not t["near"] and t["c"].rstrip(".") == bare:
            out += [token(*p.split(" ")) for p in t["parts"]]
        elif bare.startswith("dd") and not _VOWEL.search(bare):
            out.append(token("đ" + bare[2:], g=t["weight"], kind=t["kind"]))
        else:
            c = t["c"].rstrip(".")
            out.append(token(c, t["like"].rstrip(".") if c.isascii() else c, tuple(x.rstrip(".") for x in t["near"] or ()), t["weight"], t["kind"]))
    return out


_TITLE_FOLDS = frozenset(fold(t) for t in TITLES)
_KIND_FOLDS = frozenset(fold(k) for k in KINDS)


def _kind_word(t: dict) -> str | None:
    """The word of kind that a token is, as it stands, without marks, as an abbreviation or as a slip; else None."""
    if t["w"] in KINDS or t["kind"] or not t["v"] and not _VOWEL.search(fold(t["w"])):
        return t["w"]
    if t["like"] in KINDS or t["like"] == t["w"] and t["w"] in _KIND_FOLDS:
        return t["like"]
    return next((v for v in t["v"] if v in KINDS), None)


def roles(tokens: list[dict], cls: str) -> dict | None:
    """core: tokens; kind: words; mark: sorted markers. None without a core."""
    core: list[dict] = []
    kind: list[str] = []
    mark: list[str] = []
    if cls == "PERSON":
        i = 0
        while i < len(tokens) - 1:  # titles lead
            for n in (4, 3, 2, 1):
                if i + n < len(tokens):
                    led = "_".join(t["w"] for t in tokens[i : i + n])
                    if led in TITLES or fold(led) in _TITLE_FOLDS and not (n == 1 and len(tokens) - i <= 4):
                        i += n
                        break
            else:
                break
        core = tokens[i:]
        return {"core": core, "kind": [], "mark": []} if core else None
    folded = [fold(t["w"]) for t in tokens]
    for i, t in enumerate(tokens):
        f = folded[i]
        if core and " ".join(folded[i : i + 2]) in BRANCH:
            mark.append("+" + "".join(folded[i + 2 :]))
            break
        if any(c.isdigit() for c in f) or f in MODELS and core:
            mark.append(f)
        elif f == "so" and i + 1 < len(tokens) and folded[i + 1].isdigit():
            continue
        else:
            k = _kind_word(t)
            # a slip counts as a word of kind only beside another
            sure = k in (t["w"], t["like"])
            beside = any(0 <= j < len(tokens) and _kind_word(tokens[j]) for j in (i - 1, i + 1))
            if k and (sure or beside):
                kind.append(k)
            else:
                core.append(t)
    return {"core": core, "kind": kind, "mark": sorted(mark)} if core else None


def forms(got: list[tuple[str, list[dict]]], cls: str) -> list[dict]:
    """The forms of a name, the main one first; each has core, kind, mark, alias."""
    read = [(how, spelled(tokens, cls)) for how, tokens in got]
    lead: list[dict] = []
    rest = []
    for how, t in read[1:]:
        r = roles(t, cls)
        if how == "in" and r is None and cls != "PERSON":
            lead += t  # a word of kind in brackets
        else:
            rest.append(r)
    first = roles(lead + read[0][1], cls)
    if first is None:
        return []
    out = [{**first, "alias": False}]
    for r in rest:
        if r:
            out.append({**r, "mark": r["mark"] or first["mark"], "alias": True})
    return out


def grams(form: dict, cls: str, q: int = 5) -> list[str]:
    """The set of a form's core: q-grams of the joined words (around the end for persons) and whole tokens. A slip counts
    as the most frequent word that it may be a slip of."""
    core = [(t["v"] or [t["w"]])[0] for t in form["core"]]
    words = [fold(t) for t in core if not t.endswith(".")]
    if len(words) < len(core):
        runs, run = [], ""
        for t in [*core, "."]:
            if t.endswith("."):
                runs += [run] if run else []
                run = ""
            else:
                run += fold(t)
    else:
        j = "".join(words)
        runs = [j + j[: q - 1] if cls == "PERSON" and len(j) > q else j]
    out = {r[i : i + q] for r in runs for i in range(max(1, len(r) - q + 1))}
    return sorted(out | {"=" + w for w in words})


def keys(form: dict, cls: str) -> list[tuple[str, int]]:
    """(key, role): two forms that `link` accepts have a key in common whose roles, as bits, make up 3.

    A slip agrees with a word that both tokens may stand for, so each key is also given with one token exchanged for such a
    word. Persons, by the ways of `link`: the same tokens in any order; the joined letters; the first two tokens (another
    name: 1, a main form: 2); two full tokens and the letters of all (with initials: 1, without: 2); the tokens in order
    (the shorter name: 1) and these without a middle one (the longer: 2). Others: the joined core and the markers, for places
    with the initials of the kind, or (1) without these, for a name that has no kind (3)."""
    core = form["core"]
    base = [fold(t["w"]) for t in core]
    may = [{fold(v) for v in t["v"]} - {b} for t, b in zip(core, base)]
    rows = [base] + [base[:i] + [v] + base[i + 1 :] for i, vs in enumerate(may) for v in sorted(vs)]
    out: dict[tuple[str, int], None] = {}
    if cls != "PERSON":
        kind = "".join(sorted(_initials(form["kind"]))) if cls == "LOC" else ""
        for r in rows:
            x = "".join(r) + "\t" + "\t".join(form["mark"])
            out[f"c{x}\n{kind}", 3] = None
            if kind:
                out[f"c{x}\n", 1] = None
        return list(out)
    n, brief = len(core), any(t["w"].endswith(".") for t in core)
    out["=" + "".join(base), 3] = None
    if n > 1:
        for a in {base[0], *may[0]}:
            for b in {base[1], *may[1]}:
                out[f"~{n} {a} {b}", 1 if form["alias"] else 2] = None
    if form["alias"] or n < 2:
        return list(out)
    for r in rows:
        out["s" + " ".join(sorted(r)), 3] = None
        full = sorted(x for x in r if not x.endswith("."))
        letters = "".join(sorted(x[:1] for x in r))
        if n > 2 and len(full) > 1:  # an initial and two full tokens at least
            for a, b in [full[:2]] if brief else combinations(full, 2):
                out[f"i{letters} {a} {b}", 1 if brief else 2] = None
        if n > 2 and not brief:
            out["d" + " ".join(r), 1] = None
            for k in range(1, n - 1) if n > 3 else ():
                out["d" + " ".join(r[:k] + r[k + 1 :]), 2] = None
    return list(out)


# ---- comparing


def _same(a: dict, b: dict) -> float:
    """Soft equality of two tokens: 1 equal, 0.9 a slip, 0.6 an initial, 0 else."""
    p, q = a["w"], b["w"]
    if p == q:
        return 1.0
    fp, fq = fold(p), fold(q)
    if p.endswith(".") or q.endswith("."):
        return 0.6 if fp[0] == fq[0] else 0.0
    if fp == fq:
        return 1.0 if p == fp or q == fq or toned(p) == toned(q) or a["v"] or b["v"] else 0.0
    va, vb = a["v"], b["v"]
    if q in va or p in vb or set(va) & set(vb) or q == fq and any(fold(v) == fq for v in va) or p == fp and any(fold(v) == fp for v in vb):
        return 0.9
    return 0.0


def _aligned(a: list[dict], b: list[dict]) -> tuple[float, list[float]]:
    """The similarity of two token rows, weighted by rarity, and the single values."""
    s = [_same(p, q) for p, q in zip(a, b)]
    g = [max(p["g"], q["g"], 0.1) for p, q in zip(a, b)]
    return sum(x * y for x, y in zip(s, g)) / sum(g), s


def _initials(kind: list[str]) -> str:
    return "".join(fold(k).rstrip(".") if not _VOWEL.search(fold(k)) else fold(k)[0] for k in kind)


def _within(a: list[str], b: list[str]) -> bool:
    rest = iter(b)
    return all(x in rest for x in a)


def kinds(x: list[str], y: list[str], cls: str) -> str | None:
    """How two phrases of kind agree: 'strong', 'x' or 'y' (that side being the short one), or None."""
    fx, fy = [fold(t) for t in x], [fold(t) for t in y]
    ix, iy = _initials(x), _initials(y)
    brief = any(not _VOWEL.search(t) for t in fx + fy)
    if sorted(fx) == sorted(fy) or ix == iy and (len(x) != len(y) or all(p == q or near(p, q) or brief for p, q in zip(fx, fy))):
        return "strong"
    if brief and len(ix) > 2 and sorted(ix) == sorted(iy):
        return "strong"
    if not x or not y:
        return "x" if not x else "y"
    if brief and (fx[-1:] != fy[-1:] or cls != "LOC") and (_within(list(ix), list(iy)) or _within(list(iy), list(ix))) and cls != "LOC":
        return "x" if len(ix) < len(iy) else "y"
    if cls != "LOC" and (_within(fx, fy) or _within(fy, fx)):
        return "x" if len(fx) < len(fy) else "y"
    return None


def link(x: dict, y: dict, cls: str, alike: bool = False) -> str | None:
    """'strong', 'x' or 'y' (weak, that side being the short one), or None. `alike`: the phrases of kind often meet."""
    if x["mark"] != y["mark"]:
        return None
    a, b = x["core"], y["core"]
    ja, jb = "".join(fold(t["w"]) for t in a), "".join(fold(t["w"]) for t in b)
    if cls == "PERSON":
        short = lambda c: sum(t["w"].endswith(".") for t in c)
        if len(b) < len(a) or (len(a) == len(b) and short(b) > short(a)):
            back = link(y, x, cls)
            return {"x": "y", "y": "x"}.get(back, back)
        if x["alias"] or y["alias"]:
            if len(a) == len(b) and len(a) > 1 and min(_aligned(a, b)[1]) >= 0.9 or ja == jb:
                return None if x["alias"] and y["alias"] else "x" if y["alias"] else "y"
            return None
        if ja == jb and len(ja) > 6:
            return "strong"
        n = len(a)
        if n == len(b) and n > 1:
            orders = [(a[k:] + a[:k], b) for k in range(n)]
            if n == 4:  # given name, middle name, family name
                orders += [(a[2:] + a[1::-1], b), (a, b[2:] + b[1::-1])]
            for left, right in orders:
                score, s = _aligned(left, right)
                if min(s) <= 0 or s.count(0.9) > 1:
                    continue
                if 0.6 not in s and score >= 0.8:
                    return "strong"
                if 0.6 in s and n - s.count(0.6) >= 2 and not short(b):
                    return "x"
        if n + 1 == len(b) and n >= 3 and not short(a + b):
            for k in range(1, n):
                s = _aligned(a, b[:k] + b[k + 1 :])[1]
                if min(s) > 0 and s.count(0.9) <= 1:
                    return "x"
        return None
    if ja != jb:
        if len(a) != len(b):
            return None
        score, s = _aligned(a, b)
        if min(s) < 0.9 or s.count(0.9) > 1 or score < 0.8:
            return None
    elif len(ja) < 3:
        return None
    kx, ky = x["kind"], y["kind"]
    if x["alias"] or y["alias"]:
        kx, ky = (kx or ky), (ky or kx)
    return kinds(kx, ky, cls) or ("strong" if alike else None)


def _hash(s: str) -> int:
    h = xxhash.xxh64_intdigest(s)
    return h - (1 << 64) if h >> 63 else h


def _class(type_: DataFrame):
    t = F.lower(F.trim("type"))
    m = F.create_map(*[F.lit(v) for kv in TYPES.items() for v in kv])
    return F.coalesce(m[t], F.upper(F.trim("type")))


def _alike(f: DataFrame, times: int, share: float) -> DataFrame:
    """(cls, ka, kb): phrases of kind found on the same core and markers `times` times, and on `share` of the cores of the
    rarer one. In a table without synonyms two kinds share a core by chance only. Places are left out."""
    u = f.where("cls not in ('PERSON', 'LOC') and phrase <> ''").select("cls", "phrase", "joined").distinct()
    n = u.groupBy("cls", "phrase").agg(F.count(F.lit(1)).alias("n"))
    x = u.alias("x").join(u.alias("y"), F.expr("x.cls = y.cls and x.joined = y.joined and x.phrase < y.phrase")).groupBy(F.col("x.cls").alias("cls"), F.col("x.phrase").alias("ka"), F.col("y.phrase").alias("kb")).agg(F.count(F.lit(1)).alias("m"))
    x = x.where(F.col("m") >= times).join(n.select("cls", F.col("phrase").alias("ka"), F.col("n").alias("na")), ["cls", "ka"]).join(n.select("cls", F.col("phrase").alias("kb"), F.col("n").alias("nb")), ["cls", "kb"])
    x = x.where(F.col("m") >= share * F.least("na", "nb")).select("cls", "ka", "kb")
    return x.unionByName(x.select("cls", F.col("kb").alias("ka"), F.col("ka").alias("kb")))


def candidates(f: DataFrame, least: float) -> DataFrame:
    """(a, na, b, nb): pairs of forms of different rows that have a key and a gram of both prefixes in common."""
    k = f.select("id", "no", F.explode("keys").alias("k")).select("id", "no", "k.*")
    met = k.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_or("role").alias("roles")).where("lo < hi and roles = 3").select("key")
    k = stored(k.join(met, "key"), "keys")
    df = f.select("cls", F.explode("grams").alias("gram")).groupBy("cls", "gram").agg(F.count(F.lit(1)).alias("df"))  # of all forms
    g = f.join(k.select("id", "no").distinct(), ["id", "no"], "left_semi").select("id", "no", "cls", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    g = g.join(df, ["cls", "gram"]).groupBy("id", "no", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    g = g.select("id", "no", "n", F.slice(F.col("grams")["gram"], F.lit(1), F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1).alias("prefix"))
    rows = k.join(g, ["id", "no"]).select("id", "no", "key", "role", "n", F.explode("prefix").alias("gram")).select("id", "no", "role", "n", F.xxhash64("key", "gram").alias("at"))
    pairs = rows.alias("x").join(rows.alias("y"), F.expr(f"x.at = y.at and x.id < y.id and (x.role | y.role) = 3 and x.n >= {least} * y.n and y.n >= {least} * x.n"))
    return pairs.select(F.col("x.id").alias("a"), F.col("x.no").alias("na"), F.col("y.id").alias("b"), F.col("y.no").alias("nb")).distinct()


def links(entities: DataFrame, short_forms: DataFrame, q: int = 5, least: float = 0.2, most: float = 0.35, ratio: int = 6, times: int = 3, share: float = 0.1) -> DataFrame:
    """(a, b, short): verified pairs of rows; short is null for strong pairs, else the id of the short side. Of the larger
    set, forms with initials share `least`, others `most`."""
    names = entities.where("id is not null and name is not null and type is not null").groupBy(F.col("id").alias("id")).agg(F.min(F.struct("name", _class(entities).alias("cls"))).alias("x")).select("id", "x.name", "x.cls")
    names = stored(names, "names")

    def read(_, cols):
        out = {k: [] for k in ("id", "cls", "no", "how", "pos", "w", "after")}
        for i, name, cls in zip(cols["id"], cols["name"], cols["cls"]):
            for no, (how, tokens) in enumerate(pieces(name, cls)):
                for pos, w in enumerate(tokens):
                    out["id"].append(i), out["cls"].append(cls), out["no"].append(no), out["how"].append(how), out["pos"].append(pos), out["w"].append(w)
                    out["after"].append(tokens[pos + 1] if pos + 1 < len(tokens) else "")
        return out if out["id"] else None

    tokens = stored(map_batches(names, read, "id long, cls string, no int, how string, pos int, w string, after string"), "tokens")
    says = _words(tokens, names.count(), short_forms, ratio)
    told = tokens.join(says, ["cls", "w"]).groupBy("id", "cls").agg(F.sort_array(F.collect_list(F.struct("no", "pos", "how", "w", "says"))).alias("tokens"))

    def shape(_, cols):
        out = {k: [] for k in ("id", "cls", "no", "form", "grams", "phrase", "joined", "brief", "keys")}
        for i, cls, tokens in zip(cols["id"], cols["cls"], cols["tokens"]):
            got: dict[int, tuple[str, list[dict]]] = {}
            for t in tokens:
                got.setdefault(t["no"], (t["how"], []))[1].append({"w": t["w"], **t["says"]})
            for n, f in enumerate(forms([got[k] for k in sorted(got)], cls)):
                out["id"].append(i), out["cls"].append(cls), out["no"].append(n), out["grams"].append(grams(f, cls, q))
                out["form"].append(json.dumps(f)), out["phrase"].append(" ".join(f["kind"]))
                out["brief"].append(any(t["w"].endswith(".") for t in f["core"]))
                out["joined"].append("".join(fold(t["w"]) for t in f["core"]) + " " + " ".join(f["mark"]))
                out["keys"].append([{"key": _hash(f"{cls}\t{k}"), "role": role} for k, role in keys(f, cls)])
        return out if out["id"] else None

    f = stored(map_batches(told, shape, "id long, cls string, no int, form string, grams array<string>, phrase string, joined string, brief boolean, keys array<struct<key: long, role: int>>"), "forms")
    pairs = candidates(f, least)
    side = lambda i, n, s: f.select(F.col("id").alias(i), F.col("no").alias(n), *([F.col("cls")] if s == "a" else []), F.col("form").alias("f" + s), F.col("grams").alias("g" + s), F.col("phrase").alias("k" + s), F.col("brief").alias("i" + s))
    wide = pairs.join(side("a", "na", "a"), ["a", "na"]).join(side("b", "nb", "b"), ["b", "nb"]).where(F.size(F.array_intersect("ga", "gb")) >= F.greatest(F.size("ga"), F.size("gb")) * F.when(F.col("ia") | F.col("ib"), least).otherwise(most))
    wide = wide.join(_alike(f, times, share).withColumn("alike", F.lit(True)), ["cls", "ka", "kb"], "left")

    def verify(_, cols):
        out = {"a": [], "b": [], "short": []}
        for a, b, cls, x, y, alike in zip(cols["a"], cols["b"], cols["cls"], cols["fa"], cols["fb"], cols["alike"]):
            got = link(json.loads(x), json.loads(y), cls, bool(alike))
            if got:
                out["a"].append(a), out["b"].append(b), out["short"].append({"x": a, "y": b}.get(got))
        return out if out["a"] else None

    return map_batches(wide.select("a", "b", "cls", "fa", "fb", "alike"), verify, "a long, b long, short long")


def entities_of(entities: DataFrame, short_forms: DataFrame) -> DataFrame:
    """(id, entity, links): for every row that has variants, its entity, named by the smallest id, and its verified links."""
    found = stored(links(entities, short_forms).distinct(), "links")
    edges = found.where("short is null").select("a", "b")
    ends = found.select(F.explode(F.array("a", "b")).alias("id"), F.struct("a", "b").alias("pair")).groupBy("id").agg(F.countDistinct("pair").alias("links"))
    ends = stored(ends, "ends")
    weak = found.where("short is not null").select("short", F.when(F.col("a") == F.col("short"), F.col("b")).otherwise(F.col("a")).alias("long"))
    while True:  # each round joins at least two entities
        comp = components(edges)
        full = stored(ends.select("id").join(comp, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), "comp")
        w = weak.join(full.select(F.col("id").alias("short"), F.col("comp").alias("cs")), "short").join(full.select(F.col("id").alias("long"), F.col("comp").alias("cl")), "long").where("cs <> cl")
        single = stored(w.groupBy("cs").agg(F.min("cl").alias("lo"), F.max("cl").alias("hi")).where("lo = hi").select(F.col("cs").alias("a"), F.col("lo").alias("b")), "single")
        if single.limit(1).count() == 0:
            return comp.join(ends, "id").select("id", F.col("comp").alias("entity"), "links")
        edges = edges.union(single)
