"""Analytics over documents, links, trees and plain tables, written for Spark DataFrames."""
