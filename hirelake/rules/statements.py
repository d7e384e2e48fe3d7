"""Words that statements on work permits, sponsorship and moving are made of, each with the classes it belongs to.

A sentence is read as a tape of words. `SPELLINGS` first makes one word of phrases that mean one thing; `CLASSES` then tells
what a word says, whatever stands around it.
"""

#: Pattern and the word it is written as, in this order, over lower-case text without apostrophes.
SPELLINGS = (
    (r"\bcase[\s-]+by[\s-]+case\b", " casebycase "),
    (r"\bgreen[\s-]?cards?\b", " greencard "),
    (r"\bh-?1-?b\b", " h1b "),
    (r"\b(?:full)[\s-]?time\b", " fulltime "),
    (r"\bu\.\s?s\.(?:\s?a\.)?|\busa\b|\bunited states(?: of america)?\b", " us "),
    (r"\bu\.\s?k\.|\bunited kingdom\b|\bgreat britain\b", " uk "),
    (r"\bsecurity clearances?\b|\bts/sci\b", " clearance "),
    (r"\b(?:work|working|employment)[\s-](?:permits?|authori[sz]ations?|visas?|pass(?:es)?)\b", " workpermit "),
    (r"\b(?:authori[sz]ed|eligible|entitled|permitted|allowed)\s+to\s+(?:legally\s+|lawfully\s+)?work\b|\b(?:legal\s+)?right\s+to\s+work\b", " maywork "),
    (r"\b(?:without|regardless of|irrespective of)\s+(?:regard\s+(?:to|for)\s+)?(?=[\w\s,]*\b(?:race|colou?r|religion|sex|gender|age|origin)\b)", " protectedtrait "),
    (r"\b(?:equal (?:employment )?opportunity|national origin|protected (?:status|class|characteristic|veteran)s?)\b", " protectedtrait "),
    (r"\bnot only\b|\bno (?:problem|issue|need to worry)\b|\bnot a problem\b", " "),
    (r"\bnot\s+(?:available\s+|offered\s+|possible\s+)?(?:for\s+)?(?:every|all|each)\b|\bnot (?:always|necessarily|guaranteed)\b|\bcannot guarantee\b|\bno guarantee\b", " notalways "),
    (r"\bnot (?:be )?(?:required|necessary|needed)\b|\bno (?:longer )?(?:requirement|need)\b", " unneeded "),
    (r"\b(?:some|certain|select|specific|many|most) (?:of (?:our|the) )?(?:positions|roles|jobs|programs|projects|contracts)\b", " somejobs "),
    (r",\s+(?=(?:we|you|it|they|this|candidates?|applicants?|the company|our)\b)", " | "),
)

_WORDS = {
    # what is talked about
    "S": "sponsor sponsors sponsored sponsoring sponsorship sponsorships",
    "V": "visa visas h1b opt cpt immigration immigrant workpermit greencard tn perm maywork",
    "Z": "citizen citizens citizenship nationals persons",
    "A": "maywork authorized authorised workpermit",
    "K": "clearance clearances cleared",
    "M": "relocate relocates relocated relocating relocation relocations",
    # how it is meant
    "N": "not no none unable cannot cant wont without dont doesnt never neither nor isnt arent wasnt wouldnt couldnt unavailable ineligible precluded decline declines unfortunately unsupported",
    "H": "casebycase notalways depending depends considered consider exceptional exceptionally discretion discretionary potentially possibly limited sometimes occasionally",
    "h": "may might could possible perhaps",
    "O": "offer offers offered offering provide provides provided providing available support supports supported supporting assist assists assistance help helps helping yes eligible welcome welcomes possible "
         "cover covers covered pay pays paid open happy willing glad sponsor sponsors sponsoring include includes included",
    "R": "must shall require requires required requirement requirements mandatory necessary needed only restricted limited need needs",
    "Y": "already currently existing unrestricted permanent permanently indefinite valid",
    "P": "protectedtrait discriminate discrimination discriminated race religion gender disability veteran",
    "I": "somejobs",
    "J": "future later",
    "U": "only solely exclusively",
    "n": "unneeded",
    # what else the words may be about
    "X": "executive executives project projects clinical trial trials study studies stakeholder stakeholders event events marketing corporate campaign campaigns team conference conferences mentoring mentor "
         "mentorship programme brand football league",
    "T": "transfer transfers",
    "D": "new",
    "F": "fulltime",
    "p": "candidate candidates applicant applicants employees international foreign individuals talent",
    # moving
    "B": "assistance support package packages bonus allowance allowances stipend stipends reimbursement reimbursed expenses expense budget costs benefit benefits help paid provided available offered covered "
         "eligible offer offers offering provide provides",
    "W": "willing willingness able ready prepared must need needs expected agree want interested required plan",
    "G": "equipment office offices site sites server servers system systems facility facilities data datacenter pipe pipes utility utilities mains workload workloads plant lab store tower furniture",
    "C": "own liable",
    # where a clause ends; a label ends and its answer begins
    "E": "| : ? but however although though unless except while whereas otherwise",
    "L": ": ?",
}
#: Ranks of the levels a word names; a title that names none has rank 2.
LEVELS = {"intern": 0, "junior": 1, "associate": 1, "senior": 3, "sr": 3, "staff": 4, "lead": 4, "principal": 5, "director": 6, "head": 6, "executive": 6}
PLAIN_RANK = 2
#: Words that name a country an offer is limited to.
COUNTRIES = {
    "us": "US", "american": "US", "uk": "GB", "british": "GB", "canada": "CA", "canadian": "CA", "germany": "DE", "german": "DE", "france": "FR", "india": "IN", "ireland": "IE", "netherlands": "NL",
    "spain": "ES", "poland": "PL", "australia": "AU", "singapore": "SG", "japan": "JP", "switzerland": "CH", "sweden": "SE", "portugal": "PT", "israel": "IL", "brazil": "BR", "mexico": "MX",
}


def _by_word() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, words in _WORDS.items():
        for word in words.split():
            out[word] = out.get(word, "") + name
    return out


#: The classes of each word, one letter a class.
CLASSES = _by_word()

#: Words that a negation, a hedge, an offer and a topic's object reach, before and after it, within the clause.
REACH = {"negation": (9, 6), "hedge": (14, 14), "offer": (7, 6), "object": (8, 8), "near": (4, 4), "required": (7, 6), "answer": 4}
#: Why an offer is not a firm one, in the order they are told.
MAY_OFFER_REASONS = ("hedged", "transfer_only", "scope_unread")
