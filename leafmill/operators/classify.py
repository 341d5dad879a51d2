"""Page classifiers over `html.page_features`; each is a predicate, the status is the first that holds."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Words and limits that mark each kind of page.
ANTI_BOT = ("验证码", "滑块", "行为验证", "人机验证", "访问受限", "cloudflare", "are you human", "verify you are human", "challenge")
WAF = ("aliyunwaf_", "acw_sc__v2", "var arg1=", "/probe.js", 'var buid = "fffffffffffffffffff"')
NOT_FOUND_TITLE = ("not found", "页面不存在", "请求的页面不存在")
REMOVED_STRONG = ("内容已删除", "章节不存在", "文章不存在", "作品不存在", "内容不可用", "页面不存在", "已下架", "已移除", "removed", "unavailable", "not available")
REMOVED_WEAK = ("因版权原因", "版权限制", "版权问题", "涉嫌侵权")
AUTH = ("登录", "注册", "请先登录", "登录后可见", "sign in", "log in", "login required", "please login")
AUTH_STRONG = ("您还未登录", "登录后看书更方便", "微信登录", "qq登录", "微博登录", "手机号登录")
PAY = ("vip", "付费", "购买", "订阅", "会员", "解锁本章", "本章需购买", "subscribe to read", "members only", "paywall")
PAY_STRONG = ("单章订阅", "余额不足", "立即充值", "解锁本章", "本章需购买", "投银票", "打赏本书")
CAPTCHA = r"""(?i)<input\b[^>]*\b(name|id)=["']?[^"'>]*captcha|<[a-z][^>]*\b(class|id)=["']?[^"'>]*captcha|<iframe\b[^>]*\bsrc=["']?[^"'>]*captcha"""
SLIDER = r"""(?i)<[a-z][^>]*\b(class|id)=(["'][^"'>]*(slider[^"'>]*verify|verify[^"'>]*slider))"""
NORMAL = r"[一-龥a-zA-Z0-9\s，。！？、,.!?;:：\"'“”‘’（）()【】\[\]\-—_&~*]"

# The signs of NORMAL below 128, one by one, which Java looks up in a table where ranges are tried in turn.
NORMAL_ASCII = "[" + "".join(f"\\x{i:02x}" for i in range(128) if re.match(NORMAL, chr(i)) and not 28 <= i <= 31) + "]+"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def n_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def no_long_paragraph(paragraphs: Column) -> Column:
    return ~F.exists(paragraphs, lambda p: F.length(p) >= 120)


def is_anti_bot(html: Column, body_lower: Column) -> Column:
    """F7."""
    marked = html.rlike(CAPTCHA) | html.rlike(SLIDER)
    return any_of(body_lower, ANTI_BOT) | marked | any_of(F.lower(html), WAF)


def is_not_found(title: Column, body: Column) -> Column:
    """F8."""
    t, b = F.lower(title), F.lower(body)
    return t.rlike(r"\b404\b") | any_of(t, NOT_FOUND_TITLE) | (any_of(b, NOT_FOUND_TITLE) & (F.length(body) < 260))


def is_removed(title: Column, body: Column, paragraphs: Column) -> Column:
    """F9."""
    t = F.lower(F.concat_ws(" ", title, body))
    return any_of(t, REMOVED_STRONG) | (any_of(t, REMOVED_WEAK) & (F.length(body) < 280) & no_long_paragraph(paragraphs))


def _blocked(body: Column, paragraphs: Column, words: tuple[str, ...], strong: tuple[str, ...]) -> Column:
    b = F.lower(body)
    return any_of(b, words) & no_long_paragraph(paragraphs) & ((n_of(b, strong) >= 2) | (F.length(body) < 280))


def is_auth_required(html: Column, body: Column, paragraphs: Column, injected: Column | None = None) -> Column:
    """F10; F26: a page whose rule found the body is exempt."""
    form = html.rlike(r"(?i)<input\b[^>]*type=[\"']?password") | html.rlike(r"(?i)<form\b[^>]*(action|id|class)=[\"'][^\"'>]*login")
    out = form | _blocked(body, paragraphs, AUTH, AUTH_STRONG)
    return out if injected is None else out & ~injected


def is_paywalled(html: Column, body: Column, paragraphs: Column, injected: Column | None = None) -> Column:
    """F11."""
    mask = html.rlike(r"(?i)(class|id)=[\"'][^\"'>]*paywall") | html.rlike(r"(?i)class=[\"'][^\"'>]*(vip|subscribe|blur)") | html.rlike(r"(?i)style=[\"'][^\"'>]*filter: blur")
    out = mask | _blocked(body, paragraphs, PAY, PAY_STRONG)
    return out if injected is None else out & ~injected


def is_directory_page(n_anchors: Column, link_len: Column, text_len: Column, n_p: Column) -> Column:
    """F12."""
    density = F.when(text_len > 0, link_len / text_len).otherwise(1.0)
    return (n_anchors >= 18) & (density >= 0.55) & (n_p <= 5)


def is_font_obfuscated(text: Column) -> Column:
    """F13. Normal signs are taken out in runs, those of ASCII before the others."""
    ratio = F.length(F.regexp_replace(F.regexp_replace(text, NORMAL_ASCII, ""), NORMAL + "+", "")) / F.greatest(F.length(text), F.lit(1))
    return (F.length(text) >= 120) & (ratio >= F.when(F.length(text) < 200, 0.6).otherwise(0.35))


def status_of(html: Column, title: Column, body: Column, paragraphs: Column, injected: Column | None = None) -> Column:
    """the first classifier that holds, else OK."""
    return (
        F.when(is_anti_bot(html, F.lower(body)), "ANTI_BOT_OR_BLOCKED").when(is_not_found(title, body), "SITE_NOT_FOUND")
        .when(is_removed(title, body, paragraphs), "CONTENT_REMOVED").when(is_auth_required(html, body, paragraphs, injected), "AUTH_REQUIRED")
        .when(is_paywalled(html, body, paragraphs, injected), "PAYWALL_BLOCKED").otherwise("OK")
    )


def access_status(features: DataFrame) -> DataFrame:
    """(page_id, status) of `html.page_features`. F26: a column `injected`, if there is one, exempts pages from log-in and payment."""
    injected = F.coalesce(F.col("injected"), F.lit(False)) if "injected" in features.columns else None
    return features.select("page_id", "url", status_of(*(F.col(c) for c in ("html", "title", "body", "paragraphs")), injected).alias("status"))


def is_next_page(text: Column) -> Column:
    return text.rlike("(?i)(下一页|next|>>|›)")


def is_page_number(text: Column) -> Column:
    return text.rlike(r"^\d+\s*/\s*\d+$") | text.rlike(r"第?\s*\d+\s*页")


def pagination_hint(anchors: DataFrame) -> DataFrame:
    """(page_id, has_pagination, next_page_url) from link texts."""
    usable = anchors.where("text <> '' and abs_url <> ''")
    nxt = is_next_page(F.col("text"))
    return usable.groupBy("page_id").agg(F.bool_or(is_page_number(F.col("text")) | nxt).alias("has_pagination"), F.min_by(F.when(nxt, F.col("abs_url")), F.when(nxt, F.col("pos"))).alias("next_page_url"))
