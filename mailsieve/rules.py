"""Rule tables.

FIXED VALUES: every list below is given data, kept as plain text in its given
order. Order matters: the first rule that hits names the reason, and each
redaction runs on the previous one's output.
"""

from __future__ import annotations

# --- FIXED VALUES: sender domains (financial) ------------------------------
FINANCIAL_DOMAINS = [
    "chase.com", "bankofamerica.com", "wellsfargo.com", "wellsfargoadvisors.com",
    "citibank.com", "citicards.com", "capitalone.com", "usbank.com", "pnc.com",
    "tdbank.com", "ally.com", "synchronybank.com", "synchrony.com", "uccu.com",
    "navyfederal.org", "paypal.com", "venmo.com", "zelle.com", "squareup.com",
    "cash.app", "stripe.com", "xpressbillpay.com", "americanexpress.com",
    "discover.com", "coinbase.com", "robinhood.com", "fidelity.com", "schwab.com",
    "vanguard.com", "betterment.com", "wealthfront.com", "etrade.com", "newrez.com",
    "newrezservicing.com", "loancare.com", "mrcooper.com", "irs.gov", "ssa.gov",
]

# --- FIXED VALUES: sender patterns -----------------------------------------
SENSITIVE_SENDERS = [
    r"noreply@.*\.gov$", r"security@", r"security-noreply@",
    r"account-security-noreply@", r"account-security@", r"verify@",
    r"no-reply@.*bank", r"alerts?@", r"fraud@", r"authentication@",
    r"noreply@.*\.bank$", r"noreply@.*financial", r"accountprotection\.",
]

# --- FIXED VALUES: subject patterns (security) -----------------------------
SECURITY_SUBJECTS = [
    r"password reset", r"reset your password", r"new password", r"password updated",
    r"password changed", r"your (temporary |new )?password", r"your code (for|is)",
    r"confirmation code", r"here.?s your (pin|code)", r"your pin", r"single.?use code",
    r"one.?time (password|code|pin)", r"otp\b", r"verification code", r"security code",
    r"login code", r"sign.?in code", r"activation link", r"activate your",
    r"confirm your", r"verify your", r"email verification", r"new sign.?in",
    r"sign.?in (attempt|link|activity)", r"login attempt", r"sign.?in to your",
    r"signed? in (to|from)", r"new device", r"magic link", r"two.?factor", r"2fa",
    r"security (alert|info|notice|update)", r"suspicious (activity|sign.?in|login)",
    r"unusual activity", r"unauthorized (access|attempt)",
]

# --- FIXED VALUES: subject patterns (financial) ----------------------------
FINANCIAL_SUBJECTS = [
    r"wire transfer", r"tax (document|return|form|statement|receipt)", r"w-?2", r"1099",
    r"bank statement", r"account statement", r"billing statement", r"your statement is",
    r"statement is (now )?available", r"credit (score|report)", r"social security",
    r"recurring payment", r"payment (successful|confirmed|drafted|processed|received)",
    r"payment confirmation", r"payment receipt", r"payment has been", r"automatic payment",
    r"owner statement", r"tax receipt", r"auto.?pay",
    r"statement is (now )?(available|here|ready)", r"your .* statement",
    r"subscription receipt",
]

# Building blocks for the java.util.regex forms. Written out because \s, \b, $
# and . mean different things there than in the dialect the rules are stated in.
WS_CHARS = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WS = f"[{WS_CHARS}]"
DOT = r"[^\n\r\x{2028}\x{2029}]"
WORD = "[0-9A-Za-z_]"
START = f"(?<!{WORD})"  # \b in front of a word character
END = f"(?!{WORD})"  # \b behind a word character
BOUND = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"  # \b anywhere

# --- FIXED VALUES: redaction patterns, in running order --------------------
# name -> (pattern, replacement). The aws_secret pattern is applied only in
# front of the last SECRET_HINT of its line (see functions.redact).
PII_PATTERNS = {
    "ssn": (rf"{START}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{END}", "[SSN_REDACTED]"),
    "card": (
        rf"{START}(?:4[0-9]{{3}}|5[1-5][0-9]{{2}}|3[47][0-9]{{2}}|6(?:011|5[0-9]{{2}}))"
        rf"[- ]?[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{{3,4}}{END}",
        "[CREDIT_CARD_REDACTED]",
    ),
    "pem": (
        r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----[\s\S]*?"
        r"-----END (?:RSA |EC |DSA )?PRIVATE KEY-----",
        "[PRIVATE_KEY_REDACTED]",
    ),
    "sk_key": (rf"{START}sk_(?:live|test)_[A-Za-z0-9]{{20,}}{END}", "[API_KEY_REDACTED]"),
    "pk_key": (rf"{START}pk_(?:live|test)_[A-Za-z0-9]{{20,}}{END}", "[API_KEY_REDACTED]"),
    "generic_key": (
        rf"(?i){START}(?:api_key|apikey|api_secret|token)[=:]{WS}*[\"']?[A-Za-z0-9_\-]{{20,}}[\"']?",
        "[API_KEY_REDACTED]",
    ),
    "aws_key": (rf"{START}AKIA[0-9A-Z]{{16}}{END}", "[AWS_KEY_REDACTED]"),
    "aws_secret": (rf"{BOUND}[A-Za-z0-9/+=]{{40}}{BOUND}", "[AWS_SECRET_REDACTED]"),
    "bearer": (rf"Bearer{WS}+[A-Za-z0-9_\-\.]{{20,}}", "Bearer [TOKEN_REDACTED]"),
    "account_ending": (
        rf"(?i)(?:account|acct|card)(?:{WS}+(?:number|no|#))?{WS}*"
        rf"(?:ending|ending in|xxxx|\.{{3,}}){WS}*[0-9]{{4}}",
        "[ACCOUNT_REDACTED]",
    ),
    "account_label": (
        rf"(?i)(?:account|acct)(?:{WS}+(?:number|no|#))?[.:{WS_CHARS}]+[0-9]{{6,}}",
        "[ACCOUNT_REDACTED]",
    ),
    "routing": (
        rf"(?i)(?:routing|aba|transit){WS}*(?:number|no|#)?{WS}*:?{WS}*[0-9]{{9}}{END}",
        "[ROUTING_NUMBER_REDACTED]",
    ),
    "dollar": (r"\$[0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{2}", "[AMOUNT_REDACTED]"),
    "email": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL_REDACTED]"),
}
SECRET_HINT = "(?i)(?:aws|secret|key)"
EMAIL_LIKE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"

# --- FIXED VALUES: injection detectors (pattern, label), in order ----------
INJECTION_PATTERNS = [
    (rf"ignore{WS}+(?:all{WS}+)?previous{WS}+instructions", "instruction override"),
    (rf"you{WS}+are{WS}+now{WS}+a", "role reassignment"),
    (rf"execute{WS}+this{WS}+command", "command execution"),
    (rf"forward{WS}+all{WS}+(?:data|emails?|messages?){WS}+to", "data exfiltration"),
    (r"\[SYSTEM\]", "system tag injection"),
    (r"<\|system\|>", "system delimiter injection"),
    (r"\[INST\]", "instruction tag injection"),
    (r"<\|im_start\|>", "chat format injection"),
    (rf"disregard{WS}+(?:all{WS}+)?(?:prior|previous|above)", "instruction override"),
    (rf"new{WS}+instructions?:{WS}", "instruction injection"),
    (rf"override{WS}+(?:safety|security|content){WS}+(?:filter|policy)", "safety bypass"),
    (rf"respond{WS}+with(?:out)?{WS}+(?:the|any){WS}+(?:restrictions?|filter)", "restriction bypass"),
    (rf"pretend{WS}+(?:you{WS}+are|to{WS}+be){WS}+", "role reassignment"),
    (rf"act{WS}+as{WS}+(?:if|though)?{WS}*(?:an?|my){WS}+", "role reassignment"),
]

# How the detectors' matches begin, one for each; a blank is any white space.
INJECTION_OPENINGS = [
    "igno", "you ", "exec", "forw", "[sys", "<|sy", "[ins", "<|im", "disr", "new ", "over", "resp", "pret", "act ",
]

# --- FIXED VALUES: invisible code points removed from text -----------------
INVISIBLE = (
    r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{2066}-\x{2069}\x{202A}-\x{202E}"
    r"\x{E0001}-\x{E007F}\x{FE00}-\x{FE0F}\x{00AD}\x{2028}\x{2029}\x{061C}\x{180E}]"
)

# --- FIXED VALUES: reply/forward prefixes ----------------------------------
REPLY_PREFIXES = ["Re", "Fwd", "Fw", "AW", "SV", "TR", "Rif"]

# --- FIXED VALUES: mailbox names -------------------------------------------
# What a query may call a folder -> its logical name.
FOLDER_ALIASES = {
    "inbox": "inbox", "sent": "sent", "trash": "trash", "drafts": "drafts", "draft": "drafts",
    "spam": "junk", "junk": "junk", "starred": "flagged", "flagged": "flagged",
    "archive": "archive", "all": "all",
}
# Logical name -> (special-use flag, usual paths in order of preference).
LOGICAL_FOLDERS = {
    "sent": (r"\Sent", ["Sent", "Sent Messages", "Sent Items", "[Gmail]/Sent Mail", "INBOX.Sent"]),
    "trash": (r"\Trash", ["Trash", "Deleted Items", "Deleted Messages", "[Gmail]/Trash", "INBOX.Trash"]),
    "drafts": (r"\Drafts", ["Drafts", "Draft", "[Gmail]/Drafts", "INBOX.Drafts"]),
    "junk": (r"\Junk", ["Junk", "Spam", "Junk E-mail", "[Gmail]/Spam", "INBOX.Junk"]),
    "archive": (r"\Archive", ["Archive", "Archives", "[Gmail]/All Mail", "INBOX.Archive"]),
    "flagged": (r"\Flagged", ["Flagged", "Starred", "[Gmail]/Starred"]),
    "all": (r"\All", ["All Mail", "[Gmail]/All Mail"]),
}
SYSTEM_LABELS = [
    "INBOX", "SENT", "DRAFTS", "TRASH", "SPAM", "STARRED", "IMPORTANT", "CATEGORY_SOCIAL",
    "CATEGORY_PROMOTIONS", "CATEGORY_UPDATES", "CATEGORY_FORUMS",
]
