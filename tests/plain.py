"""Plain Python statements of the definitions, used to check the Spark operators."""

FACTOR = 5273868790340039597


def kmer_hash(kmer, k, factor=FACTOR):
    code = 0
    for base in kmer:
        code = code * 4 + "ACGT".index(base)
    return (code * factor % 2**64) >> (64 - 2 * k)


def reverse_complement(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def canonical(seq, k, factor=FACTOR):
    """(hash, is_fwd) of every k-mer."""
    seq = "".join(c if c in "ACGT" else "A" for c in seq.upper())
    out = []
    for p in range(len(seq) - k + 1):
        kmer = seq[p:p + k]
        forward = kmer_hash(kmer, k, factor)
        reverse = kmer_hash(reverse_complement(kmer), k, factor)
        out.append((min(forward, reverse), forward < reverse))
    return out


def sampled(seq, k, w, factor=FACTOR):
    return [(p, h, f) for p, (h, f) in enumerate(canonical(seq, k, factor)) if h % w == 0]


def random_dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))
