"""Replacements for detected values as native columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def mask(value: Column, keep_prefix: int | Column = 0, keep_suffix: int | Column = 0, char: str | Column = "*") -> Column:
    """First and last characters stay, those between become ``char``. A value that they would cover whole stays as it is."""
    prefix, suffix, mark = (F.lit(x) if not isinstance(x, Column) else x for x in (keep_prefix, keep_suffix, char))
    size = F.length(value)
    hidden = F.concat(F.substr(value, F.lit(1), prefix), F.repeat(mark, size - prefix - suffix), F.substr(value, size - suffix + 1, suffix))
    return F.when((size == 0) | (prefix + suffix >= size), value).otherwise(hidden)


def mask_email(value: Column, keep_prefix: int | Column = 2, char: str | Column = "*") -> Column:
    """The local part keeps its first characters if it has more; of the domain only the last label stays, dots go too."""
    prefix, mark = (F.lit(x) if not isinstance(x, Column) else x for x in (keep_prefix, char))
    domain = F.substring_index(value, "@", -1)
    local = F.substr(value, F.lit(1), F.length(value) - F.length(domain) - 1)
    shown = F.when(F.length(local) > prefix, F.concat(F.substr(local, F.lit(1), prefix), F.repeat(mark, F.length(local) - prefix))).otherwise(F.repeat(mark, F.length(local)))
    last = F.substring_index(domain, ".", -1)
    rest = F.length(domain) - F.length(last) - 1
    hidden = F.when(domain.contains("."), F.concat(F.repeat(mark, rest), F.lit("."), last)).otherwise(F.repeat(mark, F.length(domain)))
    return F.concat(shown, F.lit("@"), hidden)


#: Made-up names and places for fake values.
SURNAMES = ("王", "李", "张", "刘", "陈", "杨", "黄", "赵", "吴", "周", "徐", "孙", "马", "朱", "胡", "林", "郭", "何", "高", "罗")
GIVEN = ("伟", "芳", "娜", "敏", "静", "丽", "强", "磊", "军", "洋", "勇", "艳", "杰", "娟", "涛", "明", "超", "霞", "平", "刚")
CITIES = ("北京市朝阳区", "上海市浦东新区", "广州市天河区", "深圳市南山区", "杭州市西湖区", "成都市武侯区", "武汉市洪山区", "南京市鼓楼区")


def _pick(values: tuple[str, ...], seed: Column, turn: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(seed, F.lit(turn)), F.lit(len(values))) + 1).cast("int"))


def _digits(seed: Column, turn: int, size: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64(seed, F.lit(turn)), F.lit(10**size)).cast("string"), size, "0")


def _fake_id(seed: Column) -> Column:
    day = F.date_format(F.date_add(F.lit("1960-01-01").cast("date"), F.pmod(F.xxhash64(seed, F.lit(2)), F.lit(14_000)).cast("int")), "yyyyMMdd")
    body = F.concat(_pick(tuple(str(p) for p in C.PROVINCES), seed, 1), F.lit("0101"), day, _digits(seed, 3, 3))
    total = sum((F.substring(body, i + 1, 1).cast("int") * w for i, w in enumerate(C.CHECK_WEIGHTS)), F.lit(0))
    return F.concat(body, F.substr(F.lit(C.CHECK_CHARACTERS), total % 11 + 1, F.lit(1)))


def _fake_card(seed: Column) -> Column:
    body = F.concat(F.lit("622848"), _digits(seed, 1, 9))
    digit = lambda i: F.substring(body, i, 1).cast("int")
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = sum((doubled(digit(i)) if i % 2 else digit(i) for i in range(1, 16)), F.lit(0))
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def fake(entity: str, value: Column, salt: str = "") -> Column:
    """A made-up value of the type. It follows from the value and ``salt`` alone, so equal values stay equal everywhere
    and reruns agree. Types without a generator keep the value."""
    seed = F.concat(F.lit(salt + "\u0000"), value)
    makers: dict[str, Callable[[], Column]] = {
        C.PHONE: lambda: F.concat(F.lit("13"), _digits(seed, 1, 9)), C.ID_CARD: lambda: _fake_id(seed), C.BANK_CARD: lambda: _fake_card(seed),
        C.PASSPORT: lambda: F.concat(_pick(("E", "G"), seed, 1), _pick(tuple("ABCDEFGHJKLMNPQRSTUVWXYZ"), seed, 2), _digits(seed, 3, 8)),
        C.EMAIL: lambda: F.concat(F.lit("user"), _digits(seed, 1, 8), F.lit("@example.com")),
        C.NAME: lambda: F.concat(_pick(SURNAMES, seed, 1), _pick(GIVEN, seed, 2), _pick(GIVEN, seed, 3)),
        C.ADDRESS: lambda: F.concat(_pick(CITIES, seed, 1), F.lit("人民路"), _digits(seed, 2, 3), F.lit("号")),
    }
    return makers[entity]() if entity in makers else value


@dataclass(frozen=True)
class Rewrite:
    """How values of a type are replaced. kind: mask, fake, replace, redact, hash, encrypt, keep or custom."""

    kind: str
    keep_prefix: int = 0
    keep_suffix: int = 0
    masking_char: str = "*"
    mask_email_domain: bool = False
    new_value: str | None = None
    hash_type: str = "sha256"
    key: str = ""
    chars_to_mask: int | None = None
    from_end: bool = False
    salt: str = ""
    function: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("mask", "fake", "replace", "redact", "hash", "encrypt", "keep", "custom"):
            raise ValueError(f"unknown operator: {self.kind}")
        if self.keep_prefix < 0 or self.keep_suffix < 0:
            raise ValueError("keep_prefix and keep_suffix must not be negative")

    def apply(self, entity: str, value: Column) -> Column:
        if self.kind == "mask" and self.chars_to_mask is not None:
            n = F.least(F.lit(self.chars_to_mask), F.length(value))
            hidden, rest = F.repeat(F.lit(self.masking_char), n), F.length(value) - n
            return F.concat(F.substr(value, F.lit(1), rest), hidden) if self.from_end else F.concat(hidden, F.substr(value, n + 1, rest))
        if self.kind == "mask":
            plain = mask(value, self.keep_prefix, self.keep_suffix, self.masking_char)
            return F.when(value.contains("@"), mask_email(value, self.keep_prefix, self.masking_char)).otherwise(plain) if self.mask_email_domain else plain
        if self.kind == "hash":
            return F.sha2(value, {"sha256": 256, "sha512": 512}[self.hash_type])
        if self.kind == "encrypt":
            return F.base64(F.aes_encrypt(value.cast("binary"), F.lit(self.key.encode())))
        simple = {"fake": lambda: fake(entity, value, self.salt), "replace": lambda: F.lit(f"<{entity}>" if self.new_value is None else self.new_value), "redact": lambda: F.lit(""), "keep": lambda: value}
        return simple[self.kind]() if self.kind in simple else self.function(value)


#: How each type is rewritten unless a call says otherwise; other types become <TYPE>.
DEFAULT_REWRITES = {
    C.PHONE: Rewrite("mask", 3, 4), C.ID_CARD: Rewrite("mask", 6, 4), C.BANK_CARD: Rewrite("mask", 4, 4), C.PASSPORT: Rewrite("mask", 2, 2),
    C.EMAIL: Rewrite("mask", 2, mask_email_domain=True), C.ADDRESS: Rewrite("replace", new_value="<CN_ADDRESS>"),
}


def requested_rewrites(request: dict[str, dict]) -> dict[str, Rewrite]:
    """Rewrites from request objects by type. Only mask and fake can be asked for; anything else leaves the default."""
    out = {}
    for entity, r in request.items():
        if r.get("type") == "mask":
            out[entity] = Rewrite("mask", r.get("keep_prefix", 0), r.get("keep_suffix", 0), r.get("masking_char", "*"), r.get("mask_email_domain", False))
        elif r.get("type") == "fake":
            out[entity] = Rewrite("fake")
    return out
