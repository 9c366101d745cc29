"""loamstone.operators"""
