from tidejoin.plans.app import main

main()
