"""Published constants of sequence analysis."""

# The standard genetic code in TCAG order.
CODON_BASES = "TCAG"
CODON_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# Fixed values by residue, in the order of RESIDUES: average residue mass, Kyte-Doolittle hydropathy, Parker
# hydrophilicity, Chou-Fasman propensities.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"


def _scale(values: str) -> dict[str, float]:
    return dict(zip(RESIDUES, map(float, values.split()), strict=True))


RESIDUE_MASS = _scale("71.0788 156.1875 114.1038 115.0886 103.1388 128.1307 129.1155 57.0519 137.1411 113.1594 113.1594 128.1741 131.1926 147.1766 97.1167 87.0782 101.1051 186.2132 163.1760 99.1326")
HYDROPATHY = _scale("1.8 -4.5 -3.5 -3.5 2.5 -3.5 -3.5 -0.4 -3.2 4.5 3.8 -3.9 1.9 2.8 -1.6 -0.8 -0.7 -0.9 -1.3 4.2")
HYDROPHILICITY = _scale("2.1 4.2 7.0 10.0 1.4 6.0 7.8 5.7 2.1 -8.0 -9.2 5.7 -4.2 -9.2 2.1 6.5 5.2 -10.0 -1.9 -3.7")
HELIX = _scale("1.42 0.98 0.67 1.01 0.70 1.11 1.51 0.57 1.00 1.08 1.21 1.16 1.45 1.13 0.57 0.77 0.83 1.08 0.69 1.06")
SHEET = _scale("0.83 0.93 0.89 0.54 1.19 1.10 0.37 0.75 0.87 1.60 1.30 0.74 1.05 1.38 0.55 0.75 1.19 1.37 1.47 1.70")
TURN = _scale("0.66 0.95 1.56 1.46 1.19 0.98 0.74 1.56 0.95 0.47 0.59 1.01 0.60 0.60 1.52 1.43 0.96 0.96 1.14 0.50")
WATER_MASS, UNKNOWN_RESIDUE_MASS = 18.01524, 110.0

# pKa of the ends and side chains.
N_TERM_PKA, C_TERM_PKA = 7.5, 3.55
POSITIVE_PKA = {"K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE_PKA = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}

# Average and monoisotopic atomic masses.
ELEMENTS = "H C N O P S Na K Ca Mg Cl F Br I Fe".split()
ATOMIC_WEIGHT = dict(zip(ELEMENTS, map(float, "1.008 12.011 14.007 15.999 30.974 32.06 22.990 39.098 40.078 24.305 35.45 18.998 79.904 126.904 55.845".split()), strict=True))
MONOISOTOPIC = dict(zip(ELEMENTS, map(float, "1.0078250319 12.0 14.0030740052 15.9949146221 30.97376151 31.97207069 22.98976928 38.9637069 39.9625912 23.9850417 34.96885268 18.99840322 78.9183376 126.9044719 55.9349421".split()), strict=True))
ADDUCTS = {"neutral": 0.0, "[M+H]+": 1.007276, "[M-H]-": -1.007276, "[M+Na]+": 22.98922, "[M+K]+": 38.96316}
