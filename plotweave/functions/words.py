"""Word lists that results depend on."""

# Words that similarity between two texts ignores.
SIMILARITY_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will",
    "with", "i", "you", "we", "they", "them", "their", "this", "these", "those", "have", "had", "been", "being", "do", "does", "did", "can", "could",
    "should", "would", "may", "might", "must", "shall", "not", "no", "nor", "but", "or", "yet", "so", "if", "when", "where", "why", "how", "what",
    "which", "who", "whom", "whose",
]

# Verbs that are never salient.
VERB_STOP_WORDS = ["could", "can", "may", "might", "will", "would", "should", "shall", "be", "'d'", ",", "’", "take", "use", "make", "have", "go", "come", "get", "do", "give", "put", "set", "argue", "say", "claim", "suggest", "tell"]

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = [
    "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Inc.", "Ltd.", "Co.", "Corp.", "U.S.", "U.K.", "E.U.", "e.g.", "i.e.", "etc.", "vs.", "Jan.", "Feb.", "Mar.",
    "Apr.", "Aug.", "Sept.", "Oct.", "Nov.", "Dec.", "a.m.", "p.m.", "St.", "Ave.", "Blvd.", "Rd.", "Gov.", "Sen.", "Rev.", "Ph.D.", "M.D.", "B.A.",
    "M.A.", "M.B.A.", "Jr.", "Sr.", "No.",
]

# Groups, roles and stances of annotated characters.
GROUPS = {
    "guncontrol": ["Politicians", "Gun Control Advocates", "Gun Rights Advocates", "Law Enforcement", "Judiciary", "Government", "Gun Crime Victims", "Other"],
    "immigration": ["Politicians", "Law Enforcement", "Judiciary", "Government", "Immigration Advocates", "Immigrants", "Refugees", "Asylum Seekers", "Workers", "Other"],
}
ROLES = ["Hero", "Victim", "Threat", "Neutral"]
CAST = ["Hero", "Victim", "Threat"]
STANCES = ["Pro", "Anti", "Neutral"]
RELATIONS = ["causal", "none"]
#: Groups counted as one.
MERGED_GROUPS = {g: "Immigrants" for g in ("Immigrants", "Refugees", "Asylum Seekers", "Workers")}
#: A name that occurs in two spellings.
GROUP_SPELLINGS = {"Gun Right Advocates": "Gun Rights Advocates"}

# Names of the frame code book. ".0" is a frame, ".1" its headline, ".2" primary.
FRAME_CODES = {
    "0": "None",
    "1.0": "Economic",
    "1.1": "Economic headline",
    "1.2": "Economic primary",
    "2.0": "Capacity and Resources",
    "2.1": "Capacity and Resources headline",
    "2.2": "Capacity and Resources primary",
    "3.0": "Morality",
    "3.1": "Morality headline",
    "3.2": "Morality primary",
    "4.0": "Fairness and Equality",
    "4.1": "Fairness and Equality headline",
    "4.2": "Fairness and Equality primary",
    "5.0": "Legality, Constitutionality, Jurisdiction",
    "5.1": "Legality, Constitutionality, Jurisdiction headline",
    "5.2": "Legality, Constitutionality, Jurisdiction primary",
    "6.0": "Policy Prescription and Evaluation",
    "6.1": "Policy Prescription and Evaluation headline",
    "6.2": "Policy Prescription and Evaluation primary",
    "7.0": "Crime and Punishment",
    "7.1": "Crime and Punishment headline",
    "7.2": "Crime and Punishment primary",
    "8.0": "Security and Defense",
    "8.1": "Security and Defense headline",
    "8.2": "Security and Defense primary",
    "9.0": "Health and Safety",
    "9.1": "Health and Safety headline",
    "9.2": "Health and Safety primary",
    "10.0": "Quality of Life",
    "10.1": "Quality of life headline",
    "10.2": "Quality of Life primary",
    "11.0": "Cultural Identity",
    "11.1": "Cultural Identity headline",
    "11.2": "Cultural Identity primary",
    "12.0": "Public Sentiment",
    "12.1": "Public Sentiment headline",
    "12.2": "Public Sentiment primary",
    "13.0": "Political",
    "13.1": "Political primary headline",
    "13.2": "Political primary",
    "14.0": "External Regulation and Reputation",
    "14.1": "External regulation and reputation headline",
    "14.2": "External Regulation and Reputation primary",
    "15.0": "Other",
    "15.1": "Other headline",
    "15.2": "Other primary",
    "16.2": "Irrelevant",
    "17.4": "Explicit Pro",
    "17.35": "Implicit Pro",
    "18.3": "Neutral",
    "19.4": "Explicit Anti",
    "19.35": "Implicit Anti",
}

#: Own list of English function words, letters, digits and punctuation; used where a general stop list is asked for.
FUNCTION_WORDS = sorted(set(SIMILARITY_STOP_WORDS) | set("me my our your yours his her hers him she himself herself itself myself than then there here once again further more most other some such only own same too very just now while about against between into through during before after above below up down out off over under because until each few any both all am were doing having s t don d ll m o re ve y".split()) | set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") | set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
