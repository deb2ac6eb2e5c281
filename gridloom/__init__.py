"""Array analytics on Spark DataFrames."""

from .array import GridArray, NotShapeable, as_array, eager, evaluate, from_table, from_vectors, glom, lazify, newaxis, optimized_dag
from .operators.creation import arange, diag, diagflat, diagonal, empty, empty_like, eye, full, full_like, identity, ndarray, ones, ones_like, rand, randint, randn, set_random_seed, sparse_diagonal, sparse_empty, sparse_rand, zeros, zeros_like
from .operators.elementwise import abs, add, astype, broadcast, divide, equal, exp, floor_divide, fmod, greater, greater_equal, less, less_equal, ln, log, logical_and, logical_not, logical_or, logical_xor, maximum, minimum, mod, multiply, negative, norm_cdf, not_equal, power, reciprocal, remainder, size, sqrt, square, sub, tocoo, true_divide, where
from .operators.image import convnet, maxpool, stencil
from .operators.indexing import assign, concatenate, mask, masked, ravel, region_map, reshape, retile, take, transpose, write
from .operators.kernels import map, map2, map_tiles, map_with_location, not_idempotent, shuffle, tile_operation
from .operators.linalg import dot, outer
from .operators.reduction import all, any, argmax, argmin, bincount, count_nonzero, count_zero, max, mean, min, norm, normalize, prod, reduce, std, sum
from .operators.sorting import argpartition, argsort, lag, partition, scan, sort, topk
from .session import forget, ship
from .sources.arrays import checkpoint, from_coo, from_file, from_file_parallel, from_numpy, load, partial_load, partial_unpickle, pickle, save, unpickle

__all__ = [n for n in dir() if not n.startswith("_")]
