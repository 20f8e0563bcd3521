"""Structural analytics over source trees and graphs, as Spark DataFrames."""
