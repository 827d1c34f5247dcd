"""Blocklist: the literal cases and the edges around them."""

import pytest

from mailsieve.operators.blocklist import with_verdict
from mailsieve.policy import Policy

ON = Policy(attachment_filtering=False)
CASES = [
    (dict(sender="statements@chase.com"), ON, "block"),
    (dict(sender="receipts@paypal.com"), ON, "block"),
    (dict(sender="office@irs.gov"), ON, "block"),
    (dict(sender="security@mail.example.net"), ON, "block"),
    (dict(sender="fraud@lender.example"), ON, "block"),
    (dict(sender="team@tool.example", subject="Your password reset link"), ON, "block"),
    (dict(subject="New bank statement for June"), ON, "block"),
    (dict(sender="jo@bakery.example", subject="Lunch on Friday"), ON, "pass"),
    (dict(sender="x@deep.alerts.chase.com"), ON, "block"),
    (dict(sender="jo@shop.example"), Policy(blocked_domains=("shop.example",)), "block"),
    (dict(sender="office@chase.com"), Policy(financial_blocking=False, sensitive_sender_blocking=False), "pass"),
    (dict(subject="Your password reset link"), Policy(security_blocking=False), "pass"),
    (dict(sender="security@mail.example.net"), Policy(sensitive_sender_blocking=False), "pass"),
    # below here: edges
    (dict(sender="sales@notchase.com"), ON, "pass"),
    (dict(sender="a@x@chase.com"), ON, "pass"),  # domain is what stands between the first two @
    (dict(sender="nobody"), ON, "pass"),
    (dict(sender="jo@shop.example"), Policy(blocked_domains=("Shop.example",)), "pass"),
    (dict(sender="x@state.gov", subject="otp2"), ON, "pass"),
    (dict(sender="noreply@state.gov\n"), ON, "pass"),  # $ is the very end
    (dict(labels=[]), Policy(allowed_folders=("inbox",)), "block"),
    (dict(labels=["Inbox"]), Policy(allowed_folders=("iNBOX",)), "pass"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(messages, i):
    row, policy, action = CASES[i]
    assert with_verdict(messages(row), policy).head()["action"] == action


def test_first_rule_in_list_order_names_the_reason(messages):
    df = messages(dict(subject="Verify your new password"), dict(sender="ALERT@bank.com", subject="password reset"))
    reasons = [r["reason"] for r in with_verdict(df).orderBy("uid").collect()]
    assert reasons == ["Blocked subject pattern: new password", "Blocked sender pattern: alerts?@"]


def test_custom_patterns_and_their_spelling(messages):
    policy = Policy(blocked_subject_patterns=("(bad", "a/b[/]", r"q\s+r"))
    df = messages(dict(subject="x A/B/ y"), dict(subject="q  r"), dict(subject="(bad"))
    reasons = [r["reason"] for r in with_verdict(df, policy).orderBy("uid").collect()]
    assert reasons == [r"Blocked subject pattern: a\/b[/]", r"Blocked subject pattern: q\s+r", None]


def test_back_references_keep_their_numbers(messages):
    policy = Policy(security_blocking=False, financial_blocking=False, blocked_subject_patterns=("(z)z?", r"(a|b)\1"))
    df = messages(dict(subject="abba"), dict(subject="abab"))
    assert [r["action"] for r in with_verdict(df, policy).orderBy("uid").collect()] == ["block", "pass"]
