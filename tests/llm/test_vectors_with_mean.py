import numpy as np
from listwright.llm import hamming


def test_pairs_of_vectors_with_a_common_direction(spark):
    rng, dim, length = np.random.default_rng(5), 64, 0.85
    axis = np.eye(dim)[0]

    def beside(n):
        x = rng.standard_normal((n, dim))
        x[:, 0] = 0
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    n, rest = 400, np.sqrt(1 - length**2)
    one, other = beside(n), beside(n)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = (0.902 - length**2) / rest**2
    both = np.concatenate((one, cosine * one + np.sqrt(1 - cosine**2) * other))
    vectors = length * axis + rest * both
    near = vectors @ vectors.T >= 0.9
    np.fill_diagonal(near, False)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    got = hamming.near_vectors(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert all(r["n_links"] <= near[r["vec_id"]].sum() for r in got)
    assert sum(r["n_links"] for r in got) >= 0.94 * near.sum()


def test_keys_get_shorter_until_the_tables_reach_the_recall():
    rng = np.random.default_rng(6)
    sample = rng.standard_normal((1000, 64)) * 0.55 / 8
    sample[:, 0] += 0.85
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    s = hamming.Settings(most_tables=40)
    codes = hamming.Codes(sample, 20, s)
    assert codes.recall >= s.recall and codes.tables <= s.most_tables and codes.key_bits < 20
