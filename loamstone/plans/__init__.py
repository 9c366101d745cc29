"""loamstone.plans"""
