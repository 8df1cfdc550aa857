"""The pattern rules of the URL filter, in the syntax of public filter lists."""

from __future__ import annotations

# Words that mark a site as unwanted where they stand alone in a host or path, by kind.
WORDS = {
    "gambling": "casino poker roulette blackjack jackpot slots bet bets betting bookmaker gambling lottery sportsbook",
    "adult": "adult adults cams camgirls erotic escort escorts hentai nude nudes porn porno sex sexy xxx",
    "drugs": "cialis pills pharmacy steroids viagra",
    "piracy": "crack cracks keygen keygens torrent torrents warez",
    "fraud": "malware payday phishing scam scams spam spammer",
    "advertising": "ads adserver adservers adservice adtech affiliate affiliates banners clickbait doubleclick popunder popups telemetry track tracker trackers",
}
#: What a word may stand between; ``||`` is the start of a host or of one of its labels, ``^`` a separator or the end.
BEFORE, AFTER = ("||", ".", "-", "/"), ("^", ".", "-")
# Further rules.
LINES = [
    "||adserver*.",  # numbered servers
    "/wp-login.",
    "/wp-login^",
    "/xmlrpc.php^",
]


def lines() -> list[str]:
    words = " ".join(WORDS.values()).split()
    return [f"{b}{w}{a}" for w in words for b in BEFORE for a in AFTER] + LINES
