"""Secret scans by one combined deterministic automaton."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcode as tc
from .automaton import TOKEN, WORD, Dfa, Rule, compile_rules

#: Credentials that are told by their own form.
TOKENS = (
    Rule("aws_access_key_id", r"A(?:KIA|SIA)[0-9A-Z]{16}"),
    Rule("github_token", r"gh[opsur]_[0-9A-Za-z]{36}"),
    Rule("github_fine_grained_token", r"github_pat_[0-9A-Za-z_]{22,}", right=False),
    Rule("gitlab_token", r"gl(?:pat|dt|rt|ptt|cbt)-[0-9A-Za-z_-]{20}", right=False),
    Rule("slack_token", r"xox[abeprs]-[0-9A-Za-z-]{10,}", right=False),
    Rule("slack_app_token", r"xapp-\d-[0-9A-Z]+-\d+-[0-9a-f]{32,}"),
    Rule("slack_webhook", r"https://hooks\.slack\.com/services/T[0-9A-Z]{8,}/B[0-9A-Z]{8,}/[0-9A-Za-z]{24}"),
    Rule("discord_webhook", r"https://discord(?:app)?\.com/api/webhooks/\d{17,20}/[0-9A-Za-z_-]{60,}", right=False),
    Rule("google_api_key", r"AIza[0-9A-Za-z_-]{35}", right=False),
    Rule("google_oauth_token", r"ya29\.[0-9A-Za-z_-]{20,}", right=False),
    Rule("google_client_secret", r"GOCSPX-[0-9A-Za-z_-]{28}", right=False),
    Rule("stripe_key", r"[rs]k_(?:live|test)_[0-9A-Za-z]{24,}"),
    Rule("stripe_webhook_secret", r"whsec_[0-9A-Za-z]{32,}"),
    Rule("prefixed_sk_key", r"sk-[0-9A-Za-z_-]{32,}", right=False),
    Rule("hub_token", r"hf_[0-9A-Za-z]{34}"),
    Rule("npm_token", r"npm_[0-9A-Za-z]{36}"),
    Rule("pypi_token", r"pypi-AgE[0-9A-Za-z_-]{50,}", right=False),
    Rule("rubygems_token", r"rubygems_[0-9a-f]{48}"),
    Rule("sendgrid_key", r"SG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}", right=False),
    Rule("mailgun_key", r"key-[0-9a-f]{32}"),
    Rule("mailchimp_key", r"[0-9a-f]{32}-us\d{1,2}"),
    Rule("twilio_key", r"(?:SK|AC)[0-9a-f]{32}"),
    Rule("square_token", r"sq0(?:atp|csp)-[0-9A-Za-z_-]{22,}", right=False),
    Rule("shopify_token", r"shp(?:at|ca|pa|ss)_[0-9A-Fa-f]{32}"),
    Rule("digitalocean_token", r"do[opr]_v1_[0-9a-f]{64}"),
    Rule("databricks_token", r"dapi[0-9a-f]{32}"),
    Rule("vault_token", r"hv[bs]\.[0-9A-Za-z_-]{24,}", right=False),
    Rule("terraform_token", r"[0-9A-Za-z]{14}\.atlasv1\.[0-9A-Za-z_-]{60,}", right=False),
    Rule("grafana_token", r"glsa_[0-9A-Za-z]{32}_[0-9A-Fa-f]{8}"),
    Rule("newrelic_key", r"NRAK-[0-9A-Z]{27}"),
    Rule("dynatrace_token", r"dt0c01\.[0-9A-Z]{24}\.[0-9A-Z]{64}"),
    Rule("sentry_token", r"sntry[su]_[0-9A-Za-z_-]{40,}", right=False),
    Rule("linear_key", r"lin_api_[0-9A-Za-z]{40}"),
    Rule("postman_key", r"PMAK-[0-9a-f]{24}-[0-9a-f]{34}"),
    Rule("doppler_token", r"dp\.(?:pt|st|ct|sa)\.[0-9A-Za-z]{40,44}"),
    Rule("planetscale_token", r"pscale_(?:tkn|pw|oauth)_[0-9A-Za-z_-]{32,}", right=False),
    Rule("atlassian_token", r"ATATT3[0-9A-Za-z_-]{40,}", right=False),
    Rule("age_secret_key", r"AGE-SECRET-KEY-1[0-9A-Z]{58}"),
    Rule("json_web_token", r"eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}", right=False),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----", right=False),
)
#: Credentials that are told by what stands before them.  A name may begin with other parts, as in DB_PASSWORD, clientSecret
#: or aws.secret_access_key, and stand in quotes.
ASSIGNMENTS = (
    Rule("assigned_secret", r"[0-9A-Za-z_.-]*(?:password|passwd|passphrase|pwd|secret|token|credentials?|(?:api|access|account|private|auth|encryption)[_-]?key)[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?[0-9A-Za-z+/_.-]{12,}", ignore_case=True, right=False),
    Rule("authorization_header", r"(?:bearer|basic) [0-9A-Za-z+/_.~-]{16,}", ignore_case=True, right=False),
    Rule("url_credentials", r"[a-z][0-9a-z+]*://[0-9A-Za-z_.-]*:[0-9A-Za-z_.!-]{4,}@", right=False),
)
RULES = TOKENS + ASSIGNMENTS


def groups(rules: tuple[Rule, ...]) -> list[tuple[Rule, ...]]:
    """The rules, by the combined automaton that scans them: as many as its masks hold.

    Rules that search for a word inside any name are kept from those that count
    the bytes of a key, since the states of one would multiply those of the other.
    """
    counted = [r for r in rules if r not in ASSIGNMENTS]
    named = [r for r in rules if r in ASSIGNMENTS]
    return [tuple(g[i : i + MASK_RULES]) for g in (counted, named) for i in range(0, len(g), MASK_RULES)]


#: Rules of one automaton.
MASK_RULES = 63
#: Bytes of text that are scanned side by side, and texts below which the rest are scanned one by one.
LANE_BYTES, FEWEST_LANES = 8 << 20, 96

_WORD = np.zeros(257, dtype=bool)
_WORD[list(WORD)] = True
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[list(TOKEN)] = True


class Scanner:
    """The automaton of all rules, and the anchored one of each rule to place its matches."""

    def __init__(self, rules: tuple[Rule, ...]):
        if len(rules) > MASK_RULES:
            raise ValueError("too many rules for one automaton's masks; see groups")
        self.rules = rules
        self.dfa = compile_rules(list(rules))
        full = self.dfa.next[:, self.dfa.kind].astype(np.int32)
        self.flat = (full << 8).ravel()
        self.hit = self.dfa.accept != 0
        self.rows = self.dfa.rows
        self.single = [_anchored(r) for r in rules]

    def masks(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each text a bit for each rule of which a match ends in it: one pass over the bytes.

        The texts are stepped side by side, one byte of each at a time; the few
        longest are finished one by one.
        """
        sizes = np.diff(off)
        order = np.argsort(-sizes, kind="stable")
        start, length = off[:-1][order], sizes[order]
        state = np.zeros(len(order), np.int32)
        found = np.zeros(len(order), np.uint64)
        lanes = np.searchsorted(-length, -np.arange(1, (int(length[0]) if len(length) else 0) + 1), side="right")
        step = 0
        while step < len(lanes) and lanes[step] >= FEWEST_LANES:
            n = lanes[step]
            s = self.flat[state[:n] + data[start[:n] + step]]
            state[:n] = s
            hit = self.hit[s >> 8]
            if hit.any():
                at = np.flatnonzero(hit)
                found[at] |= self.dfa.accept[s[at] >> 8]
            step += 1
        for i in range(int(lanes[step]) if step < len(lanes) else 0):
            found[i] |= np.uint64(self._rest(data[start[i] + step : start[i] + length[i]].tobytes(), int(state[i]) >> 8))
        out = np.zeros(len(order), np.uint64)
        out[order] = found
        return out

    def _rest(self, data: bytes, state: int) -> int:
        rows, mask = self.rows, 0
        row = rows[state]
        for b in data:
            row = rows[row[b]]
            if row[256]:
                mask |= row[256]
        return mask

    def spans(self, rule: int, data: bytes) -> list[tuple[int, int]]:
        """Leftmost-longest matches of one rule that don't overlap, as byte ranges."""
        rows, first, r = self.single[rule], self.rules[rule], self.rules[rule]
        starts = np.frombuffer(data, np.uint8)
        can = np.array([rows[0][b] != rows[0][256] for b in range(256)])[starts]
        if first.left:
            can &= ~np.concatenate([[False], _TOKEN[starts[:-1]]])
        out, done = [], 0
        for s in np.flatnonzero(can).tolist():
            if s < done:
                continue
            state, end = 0, -1
            for i in range(s, len(data)):
                state = rows[state][data[i]]
                if state == rows[0][256]:
                    break
                if rows[state][257] and (not r.right or _WORD[data[i]] and (i + 1 == len(data) or not _WORD[data[i + 1]])):
                    end = i + 1
            if end > s:
                out.append((s, end))
                done = end
        return out


def _anchored(rule: Rule) -> list[array]:
    """Rows of next states; then the number of the dead state and whether the state accepts."""
    dfa: Dfa = compile_rules([rule], anchored=True)
    dead = [s for s in range(len(dfa.next)) if not dfa.accept[s] and (dfa.next[s] == s).all()]
    full = dfa.next[:, dfa.kind]
    return [array("i", [*map(int, full[s]), dead[0] if dead else -1, int(dfa.accept[s] != 0)]) for s in range(len(full))]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def raw_bytes(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, of either offset width, and its row offsets."""
    off = np.concatenate([[0], np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if not off[-1]:
        return np.zeros(0, np.uint8), off
    wide = np.int64 if pa.types.is_large_string(part.type) else np.int32
    first = int(np.frombuffer(part.buffers()[1], wide)[part.offset])
    return np.frombuffer(part.buffers()[2], np.uint8, count=int(off[-1]), offset=first), off


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rule, hit, n_chars, fingerprint) of every match, without a shuffle.

    ``hit`` numbers the matches of a rule in a text from 1; the match itself is
    reported only by its length and SHA-256, so that the report holds no secrets.
    Matches of one rule don't overlap and are leftmost-longest; different rules may
    match in one place.  Null and empty texts have no matches; repeated rows are
    reported again; other columns are ignored.
    """

    # compiled once; some thousand states, whatever the texts
    known = docs.sparkSession.sparkContext.broadcast([(g, scanner(g)) for g in groups(rules)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for a, b in tc.slices(batch.column(1), LANE_BYTES):
                part = batch.column(1).slice(a, b - a)
                data, off = raw_bytes(part)
                for group, scan in known.value:
                    masks = scan.masks(data, off)
                    for i in np.flatnonzero(masks).tolist():
                        raw = data[off[i] : off[i + 1]].tobytes()
                        for k, rule in enumerate(group):
                            if int(masks[i]) >> k & 1:
                                for hit, (s, e) in enumerate(scan.spans(k, raw), 1):
                                    text = raw[s:e]
                                    out.append((ids[a + i], rule.name, hit, len(text.decode("utf-8", "replace")), hashlib.sha256(text).hexdigest()))
            if out:
                d, r, h, n, f = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(r), pa.array(h, pa.int32()), pa.array(n, pa.int32()), pa.array(f)], ["doc_id", "rule", "hit", "n_chars", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, rule string, hit int, n_chars int, fingerprint string")
