"""loamstone.sources"""
