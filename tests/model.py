"""A plain model of the rules, one text at a time, to hold the native plans against."""

import datetime
import re

from veilspark import constants as C


def phone_ok(v):
    v = re.sub(r"[\s\-+]", "", v)
    v = v[2:] if v.startswith("86") else v
    v = v[4:] if v.startswith("0086") else v
    return re.fullmatch(r"1[3-9]\d{9}", v) is not None


def id_ok(v, as_of):
    v = v.replace(" ", "")
    if not re.fullmatch(r"[0-9]{17}[0-9Xx]", v) or int(v[:2]) not in C.PROVINCES:
        return False
    try:
        day = datetime.date(int(v[6:10]), int(v[10:12]), int(v[12:14]))
    except ValueError:
        return False
    return day.year >= 1900 and day <= as_of and C.CHECK_CHARACTERS[sum(int(c) * w for c, w in zip(v, C.CHECK_WEIGHTS)) % 11] == v[17].upper()


def luhn(v):
    total = 0
    for i, c in enumerate(reversed(v)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passport_ok(v):
    return 6 <= len(v) <= 15 and any(re.fullmatch(p, v) for p, _ in C.PASSPORT_PATTERNS)


def email_ok(v):
    local, _, domain = v.rpartition("@")
    return 1 <= len(local) <= 64 and 1 <= len(domain) <= 255 and not any(x.startswith(".") or x.endswith(".") for x in (local, domain)) and ".." not in v


def clash(a, b):
    return a[1] < b[2] and b[1] < a[2]


def phones(t):
    hits = []
    for p, score in C.PHONE_PATTERNS:
        for m in re.finditer(p, t):
            left, right = re.search(r"\d*$", t[: m.start()])[0], re.match(r"\d*", t[m.end() :])[0]
            if phone_ok(m[0]) and len(left) + len(right) < 5:
                hits.append((C.PHONE, m.start(), m.end(), score))
    kept = []
    for h in sorted(hits, key=lambda h: (h[1], -h[3])):
        if not any(clash(h, k) for k in kept):
            kept.append(h)
    return kept


def contained(hits):
    kept = []
    for h in sorted(hits, key=lambda h: (-h[3], h[1], h[1] - h[2])):
        if h[3] and not any(k[0] == h[0] and k[1] <= h[1] and h[2] <= k[2] for k in kept):
            kept.append(h)
    return kept


def scan(t, as_of):
    hits = phones(t)
    hits += [(C.ID_CARD, m.start(), m.end(), C.ID_CARD_SCORE) for m in re.finditer(C.ID_CARD_PATTERN, t) if id_ok(m[0], as_of)]
    for m in re.finditer(C.ID_CARD_LONG_PATTERN, t):
        v = m[0].replace(" ", "")
        if len(v) == 19 and any(id_ok(v[:i] + v[i + 1 :], as_of) for i in C.REPAIR_ORDER):
            hits.append((C.ID_CARD, m.start(), m.end(), C.ID_CARD_LONG_SCORE))
    for m in re.finditer(C.BANK_CARD_PATTERN, t):
        v = m[0].replace(" ", "")
        if re.fullmatch("[0-9]{16,19}", v) and luhn(v):
            hits.append((C.BANK_CARD, m.start(), m.end(), C.BANK_CARD_SCORES[v[:6] not in C.BANK_BINS]))
    passports = contained([(C.PASSPORT, m.start(), m.end(), s) for p, s in C.PASSPORT_PATTERNS for m in re.finditer(p, t, re.I)])
    hits += [h for h in passports if passport_ok(t[h[1] : h[2]])]
    for m in re.finditer(C.EMAIL_PATTERN, t):
        if email_ok(m[0]):
            hits.append((C.EMAIL, m.start(), m.end(), C.EMAIL_SCORES[m[0].rpartition("@")[2].lower() not in C.MAIL_DOMAINS]))
    return hits


def priority(hits, numbers=C.PRIORITIES):
    """The rule as stated, against all kept spans; not only the last."""
    if len(hits) <= 1:
        return list(hits)
    kept = []
    for h in sorted(hits, key=lambda h: (h[1], h[2])):
        rivals = [k for k in kept if clash(h, k)]
        if all(numbers.get(h[0], 99) < numbers.get(k[0], 99) for k in rivals):
            kept = [k for k in kept if k not in rivals] + [h]
    return kept


def analyze(t, as_of):
    hits = [h for h in contained(scan(t, as_of)) if h[3] >= C.DEFAULT_THRESHOLD and h[3] >= C.THRESHOLDS[h[0]]]
    return sorted(priority(hits), key=lambda h: h[1])
