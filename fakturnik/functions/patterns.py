"""Patterns of invoice text in the dialect of Java (for Spark) and of RE2 (for SQL checks).

Fixed values: the patterns must match what users of invoice extraction expect of the same labels.
Java needs (?U) for Unicode classes, (?d) where '.' must stop at a newline only, and \\z for the end.
"""

from __future__ import annotations

import re

AM = r"\d{1,3}(?:[\s\x{00a0}]?\d{3})*"

NIP = r"(?iU)(?:NIP|N\.I\.P\.?)[\s:]*(\d{3})[- ]?(\d{3})[- ]?(\d{2})[- ]?(\d{2})"
NIP_STANDALONE = r"(?U)\b(\d{3})[- ]?(\d{3})[- ]?(\d{2})[- ]?(\d{2})\b"
REGON = r"(?iU)(?:REGON|REG\.?)[\s:]*(\d{9}|\d{14})"
REGON_STANDALONE = r"(?U)\b(\d{9})\b|\b(\d{14})\b"
DATE_DMY = r"(?U)\b(\d{1,2})[./\-](\d{1,2})[./\-](\d{4}|\d{2})\b"
DATE_YMD = r"(?U)\b(\d{4})[./\-](\d{1,2})[./\-](\d{1,2})\b"
MONTHS = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia")
DATE_LONG = r"(?U)(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})"
ISSUE_DATE = r"(?iUd)(?:data\s+(?:wystawienia|faktury)|wystawion[ao]?\s+dnia?)[\s:]*(.+?)(?:\n|\z)"
SALE_DATE = r"(?iUd)(?:data\s+sprzeda[żz]y|data\s+dostawy|data\s+wykonania)[\s:]*(.+?)(?:\n|\z)"
DUE_DATE = r"(?iUd)(?:termin\s+p[łl]atno[śs]ci|termin\s+zap[łl]aty|p[łl]atne?\s+do)[\s:]*(.+?)(?:\n|\z)"
AMOUNT = rf"(?U)({AM})[,.](\d{{2}})\b"
AMOUNT_WITH_CURRENCY = rf"(?U)({AM})[,.](\d{{2}})\s*(PLN|zł|EUR|€|USD|\$|GBP|£)"
TOTAL_GROSS = rf"(?iU)(?:razem|suma|do\s+zap[łl]aty|kwota\s+brutto|warto[śs][ćc]\s+brutto)[\s:]*({AM}[,.]\d{{2}})"
TOTAL_NET = rf"(?iU)(?:netto|warto[śs][ćc]\s+netto|razem\s+netto)[\s:]*({AM}[,.]\d{{2}})"
TOTAL_VAT = rf"(?iU)(?:VAT|podatek|kwota\s+VAT|razem\s+VAT)[\s:]*({AM}[,.]\d{{2}})"
VAT_RATE = r"(?iU)(23|8|5|0|zw\.?|np\.?|oo)%?"
VAT_BREAKDOWN = rf"(?iU)(23|8|5|0|zw\.?|np\.?)%?\s*({AM}[,.]\d{{2}})\s*({AM}[,.]\d{{2}})"
IBAN = r"(?iU)(?:IBAN[\s:]*)?(PL)?[\s]?(\d{2})[\s]?(\d{4})[\s]?(\d{4})[\s]?(\d{4})[\s]?(\d{4})[\s]?(\d{4})[\s]?(\d{4})"
BANK_ACCOUNT = r"(?iUd)(?:(?:nr|numer)\s+(?:konta|rachunku)|rachunek\s+bankowy|konto)[\s:]*(.+?)(?:\n|\z)"
INVOICE_NUMBER = r"(?iU)(?:faktura\s+(?:VAT\s+)?(?:nr|numer)|nr\s+faktury|numer\s+faktury)[\s:]*([A-Za-z0-9/\-_]+)"
INVOICE_NUMBER_STANDALONE = r"(?iU)(?:FV|F|FA|FVS)[\s/\-]?(\d{1,6})[/\-](\d{2,4})"
SELLER = r"(?iU)(?:sprzedawca|wystawca|dostawca)[\s:]*"
BUYER = r"(?iU)(?:nabywca|kupuj[aą]cy|odbiorca|zamawiaj[aą]cy)[\s:]*"
PAYMENT_METHOD = r"(?iU)(?:forma\s+p[łl]atno[śs]ci|spos[óo]b\s+p[łl]atno[śs]ci|metoda\s+p[łl]atno[śs]ci)[\s:]*(\w+)"
POSTAL_CODE = r"(?U)\b(\d{2})-(\d{3})\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?:\+48[\s\-]?)?(?:\d{3}[\s\-]?\d{3}[\s\-]?\d{3}|\d{2}[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2})"
STREET = r"(?iU)(ul\.|al\.|pl\.)\s*[^\n,]+"


def re2(pattern: str) -> str:
    """The pattern as SQL text for RE2: no U and d flags, Unicode classes written out, quotes doubled."""
    flags = "(?i)" if pattern.startswith("(?iU") else ""
    body = re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern)
    out, i, inside = [], 0, False
    members = {"s": r"\s\x0b\p{Z}\x{0085}", "d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{Nd}_"}
    while i < len(body):
        two = body[i : i + 2]
        if len(two) == 2 and two[0] == "\\":
            out.append(members[two[1]] if inside and two[1] in members else f"[{members[two[1]]}]" if two[1] in members else two)
            i += 2
            continue
        inside = True if two[0] == "[" else False if two[0] == "]" else inside
        out.append(two[0])
        i += 1
    return flags + "".join(out).replace("'", "''")
